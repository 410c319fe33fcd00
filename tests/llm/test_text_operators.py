"""Operators on single texts, against brute force, libraries and exact round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexflow.llm import bpe, decontam, langid, licenses, media, pieces, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "The gnu GNU General  Public-License!", "naïve ÉTÉ ｆｕｌｌ 漢字 ½ x²", "tab\there\x1c\x85   nb  two", "'s 's ''ll x'LL", "🙂🙂 ‍🙂", "<|endoftext|>", "ab" * 5000, "word " * 3000, " trailing  "]


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def random_text(rng, n):
    return "".join(rng.choice(["the ", "of", " ", "ing", "x", "É", "ß", "漢", ".\n", "12", "!", "'s", "  "]) for _ in range(n))


# 1 decontamination


def brute_decontamination(text, items, window=10):
    w = decontam.words(text)
    hit, found = set(), set()
    for item_id, t in items:
        b = decontam.words(t)
        size = min(window, len(b))
        windows = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item_id))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def decontam_case(rng):
    vocabulary = list("abcdef")
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 9, 10, 14])))) for i in range(12)] + [(90, None), (91, "..."), (92, "É É"), (93, "a")]
    items = [x for x in items if x[1] != "a" or x[0] == 93]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(30)] + [*ODD, "x " + (items[3][1] or "").upper() + "!!", "é é", "É É"]
    return items, texts


@pytest.mark.parametrize("pass_bytes", [16_000_000, 60])
def test_decontamination(spark, pass_bytes):
    items, texts = decontam_case(random.Random(5))
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 3"))  # a repeated row
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.contamination(docs, bench, pass_bytes=pass_bytes).collect())
    assert got == sorted((i, *brute_decontamination(t, items)) for i, t in [*enumerate(texts), (3, texts[3])])
    kept = {r.doc_id for r in decontam.drop_contaminated(docs, bench, pass_bytes=pass_bytes).collect()}
    assert kept == {i for i, t in enumerate(texts) if not brute_decontamination(t, items)[1]}
    assert decontam.contamination(docs.limit(0), bench).count() == 0 and not decontam.contamination(docs, bench.limit(0)).where("contaminated").count()


def test_wu_manber_moves_on():
    m = decontam.WuManber(4, b"a b c d c d x c d y".split(), [0, 2, 6], [1, 2, 3])
    text = b"q q a b c d c d c d y x c d y".split()
    want = [(i, v) for i in range(len(text) - 3) for p, v in ((b"a b c d", 1), (b"c d c d", 2), (b"x c d y", 3)) if text[i : i + 4] == p.split()]
    assert list(m.search(text)) == want and m.shift.get((b"q", b"q"), m.default) == 3


def test_decontamination_edges(spark, monkeypatch):
    """A long item in segments, a very long text, items of one id, a null id, extra columns of clashing names."""
    rng = random.Random(6)
    long = " ".join(rng.choice("abcdefghijkl") + str(rng.randint(0, 99)) for _ in range(400))
    items = [(1, long), (2, "one two three"), (2, "four five"), (None, "six seven"), (3, "a0 " * 30)]
    w = long.split()
    texts = [" ".join(w[i : i + 12]) for i in (0, 95, 388)] + ["x " * 100_000 + "one TWO three " + long, "four one two five", "six seven four five", "a0 " * 11]
    monkeypatch.setattr(decontam, "SEGMENT", 50)
    docs = frame(spark, texts)
    for c in ("h", "n", "hits", "items", "copies", "pass"):
        docs = docs.withColumn(c, F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("pass", F.lit("x"))
    for pass_bytes in (3_000_000, 200):
        got = sorted(tuple(r) for r in decontam.contamination(docs, bench, pass_bytes=pass_bytes).collect())
        assert got == [(i, *brute_decontamination(t, [x for x in items if x[0]])) for i, t in enumerate(texts)]
        assert decontam.drop_contaminated(docs, bench, pass_bytes=pass_bytes).columns == docs.columns


# 2 licenses


def test_licenses_base(spark):
    texts = [*ODD, "x Apache\nLICENSE apache license; mit license cc-by gnu general public license", "mit-license", "mit licenses"]
    for row, text in zip(licenses.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect(), texts, strict=True):
        w = [x.decode() for x in licenses.words(text)]
        at = [(i, label) for i in range(len(w)) for p, label in licenses.BASE.items() if w[i : i + len(p.split())] == p.split()]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert row.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1


def test_whole_licences(spark):
    """A full-text label needs the warranty wording; optional parts may be left out, mandatory words may not differ."""
    def plain(template, keep):
        template = re.sub(r"<<optional>>(.*?)<</optional>>", r"\1" if keep else "", template)
        return re.sub(r"<<var;words=(\d+)-\d+>>", lambda m: "some " * max(1, int(m[1])), template)

    texts, want = [], []
    for label in ("mit", "bsd", "isc"):
        for keep in (True, False):
            whole = plain(licenses.TEMPLATES[f"full-{label}"], keep)
            texts += ["Head 2020.\n" + whole.upper() + " tail", whole.rsplit(" ", 3)[0], re.sub("(?i)in no event", "in any event", whole), plain(licenses.TEMPLATES[f"text-{label}"], keep)]
            want += [{f"text-{label}", f"full-{label}"}] + [{f"text-{label}"}] * 3
    rows = licenses.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()
    assert [{x for x in r.labels.split(",") if x[:5] in ("text-", "full-")} for r in rows] == want and {r.score for r in rows} == {1.0}


def test_templates():
    a = licenses.Automaton("keep <<optional>>the <<optional>>big<</optional>> one<</optional>> and <<var;words=1-3>> end")
    for text, ok in {"keep and x end": 1, "keep the one and x y z end": 1, "keep the big one and x end": 1, "keep big and x end": 0, "keep and end": 0, "keep and a b c d end": 0, "keep the and x end": 0, "keep and and and end end": 1}.items():
        assert a.accepts_at(text.encode().split(), 0) == bool(ok), text
    pattern = re.compile(licenses.template_regex("keep <<optional>>the<</optional>> and <<var;words=0-2>> end"))
    b, rng = licenses.Automaton("keep <<optional>>the<</optional>> and <<var;words=0-2>> end"), random.Random(1)
    for _ in range(300):
        w = ["keep", *[rng.choice(["the", "and", "end", "x"]) for _ in range(rng.randint(0, 6))]]
        assert b.accepts_at([x.encode() for x in w], 0) == bool(pattern.match("".join(f" {x} " for x in w)))
    for bad in ("<<var;words=0-1>> b", "<<var;words=1-2>> b", "a <<optional>> b"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)
    mit = re.sub(r"<<[^>]*>>", "", licenses.TEMPLATES["text-mit"])
    assert licenses.Scanner().scan(mit)[3] >= {"text-mit"} and not licenses.Scanner().scan(mit.replace("sublicense", "sell"))[3]


# 5 media


def test_media_round_trip(spark):
    out = {r.doc_id: r for r in media.media_features(media.to_media(frame(spark, ODD))).collect()}
    for i, t in enumerate(ODD):
        n, payload = media.payload_of(t)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.encode_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and len(payload) % 64 == 0 and len(payload) > 0
    assert out[0].feature == out[1].feature


def plain_cosine_hash(payload, side=32, low=8):
    """The feature by plain sums: block means of 64 pixels wide rows, cosine transform, frequencies against their median."""
    rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
    n = len(rows)
    small = []
    for y in range(side):
        a, b = y * n // side, max(y * n // side + 1, (y + 1) * n // side)
        small.append([sum(rows[i][j] for i in range(a, b) for j in range(2 * x, 2 * x + 2)) / (2 * (b - a)) for x in range(side)])
    cos = [[math.cos(math.pi * (2 * i + 1) * u / (2 * side)) for i in range(side)] for u in range(low)]
    found = [round(sum(small[y][x] * cos[u][y] * cos[v][x] for y in range(side) for x in range(side)), 6) for u in range(low) for v in range(low)]
    ranked = sorted(found[1:])
    return found, ranked[len(ranked) // 2]


def test_media_features_against_plain_sums(spark):
    rng = random.Random(14)
    texts = ["", "abc", random_text(rng, 400), random_text(rng, 3000), "x" * 700, "The same text. " * 90]
    for r in media.media_features(media.to_media(frame(spark, texts))).collect():
        found, middle = plain_cosine_hash(media.payload_of(texts[r.doc_id])[1])
        bits = f"{int(r.feature, 16):064b}"
        assert all(b == str(int(v > middle)) for b, v in zip(bits, found, strict=True) if abs(v - middle) > 1e-5)


def edge_table(spark, names):
    """A null id, repeated rows and ids, a very long text, extra columns of the given names."""
    docs = spark.createDataFrame([(None, "no id", "en", "s", 1), (1, "one", "en", "s", 1), (1, "one", "en", "s", 1), (1, "other words", "en", "s", 1), (2, None, None, None, None), (3, "mit license long " * 60_000, "en", "s", 1)], DOCS)
    for c in names:
        docs = docs.withColumn(c, F.lit("x"))
    return docs


def test_map_operators_edges(spark):
    """License scans, media and BPE: a row for each row, whatever the table; equal texts give equal results; an empty table gives an empty one."""
    cases = [
        (licenses.scan_licenses, ("labels", "score", "n_words")),
        (lambda d: media.media_features(media.to_media(d)), ("media", "feature", "n_bytes")),
        (lambda d: bpe.encode_documents(d, with_ids=True), ("ids", "n_tokens", "decoded_sha256")),
    ]
    for operator, names in cases:
        docs = edge_table(spark, names)
        rows = sorted(map(repr, (tuple(r) for r in operator(docs).collect())))
        assert len(rows) == 6 and len(set(rows)) == 5 and operator(docs.limit(0)).count() == 0
    long = {r.doc_id: r for r in licenses.scan_licenses(edge_table(spark, ())).collect()}[3]
    assert (long.n_words, long.n_base, long.first_word, long.last_word) == (180_000, 60_000, 0, 179_997)


def test_png_filters_and_damage():
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (7, 5), dtype=np.uint8)
    scan = np.zeros((7, 6), np.uint8)
    for y in range(7):
        kind = scan[y, 0] = y % 5
        for x in range(5):
            left, up = int(pixels[y, x - 1]) if x else 0, int(pixels[y - 1, x]) if y else 0
            corner = int(pixels[y - 1, x - 1]) if x and y else 0
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            scan[y, x + 1] = (int(pixels[y, x]) - (0, left, up, (left + up) // 2, paeth)[kind]) % 256
    assert (media._unfilter(scan) == pixels).all()
    good = media.encode_png(bytes(range(128)))
    assert media.decode_png(good).tobytes() == bytes(range(128))
    for bad in (b"x" + good[1:], good[:40] + bytes([good[40] ^ 1]) + good[41:], good[:-5]):
        with pytest.raises(ValueError):
            media.decode_png(bad)
    near = media.dct_hash(media.decode_png(media.encode_png(bytes(range(64)) * 64)))
    other = media.dct_hash(media.decode_png(media.encode_png(bytes(range(64)) * 63 + bytes(range(1, 65)))))
    assert bin(int(near, 16) ^ int(other, 16)).count("1") <= 6


# 6 and 8 learning


@pytest.fixture
def labelled(spark):
    rng = random.Random(2)
    common = ["the", "of", "ati", "on", "er", "inthe", "ha", "wh"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(common) + rng.choice(["", "re", "st"]) for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "grobian" + rng.choice("abcdefgh")]))
        lang = "xx" if i % 3 else "yy"
        rows.append((i, " ".join(w) + (" ñuñ çaç" * 3 if lang == "yy" else ""), lang, "s", 0))
        labels.append((i, int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "12 34 --", "xx", None, None), (None, "the of", "xx", None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert len(out) == 604
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held) and sum(out[i].predicted == (i % 4 == 0) for i in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values()) and out[1000].predicted == out[1001].predicted == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}
    # labels of held-out rows are not read
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, flipped)
    assert (again.steps, again.slope, again.shift) == (model.steps, model.slope, model.shift)
    neutral = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(docs, neutral).collect()} and toxicity.score_documents(docs.limit(0), model).count() == 0


def brute_kneser_ney(corpus, fit, significant=toxicity.SIGNIFICANT):
    """The models by plain loops over all words."""

    def stat(t, n, all_t, all_n):
        def weight(x):
            return x * math.log(x) if x > 0 else 0.0

        cells, sums = [t, n - t, all_t - t, all_n - n - all_t + t], [n, all_n - n, all_t, all_n - all_t]
        return 2 * (sum(map(weight, cells), weight(all_n)) - sum(map(weight, sums)))

    def steps_of(pairs):
        return Counter(e for _, w in pairs for e in [b"", *toxicity.chain(w)])

    docs, pairs, three = (Counter(), Counter()), (Counter(), Counter()), (set(), set())
    for text, y in fit:
        w = [b"", b"", *toxicity.words(text)]
        docs[y].update({b"", *(e for x in w[2:] for e in toxicity.chain(x))})
        pairs[y].update(zip(w[1:], w[2:], strict=False))
        three[y].update(zip(w, w[1:], w[2:], strict=False))
    n_docs = [sum(y == k for _, y in fit) for k in (0, 1)]
    for k in (0, 1):
        docs[k][b""] = n_docs[k]
    steps = [steps_of(p) for p in pairs]
    shared = steps_of({p for t in corpus if t for w in [toxicity.words(t)] for p in zip([b"", *w], w, strict=False)})
    kept = {e for e in steps[0] | steps[1] if e and stat(docs[1][e], docs[0][e] + docs[1][e], docs[1][toxicity.parent(e)], sum(d[toxicity.parent(e)] for d in docs)) >= significant}
    of_pair = [Counter(x[1:] for x in t) for t in three]
    of_word = [Counter(x[2] for x in t) for t in three]
    found = {p: (pairs[0][p], pairs[1][p]) for p in of_pair[0] | of_pair[1] if stat(of_pair[1][p], of_pair[0][p] + of_pair[1][p], of_word[1][p[1]], of_word[0][p[1]] + of_word[1][p[1]]) >= significant}
    firsts = {v: tuple(f(c for (x, _), c in pairs[y].items() if x == v) for f in (sum, lambda z: len(list(z))) for y in (0, 1)) for v, _ in found}
    kinds = {p: tuple(sum(toxicity.parent(e) == p for e in steps[y] if e) for y in (0, 1)) for p in {toxicity.parent(e) for e in shared if e}}
    return toxicity.KneserNey({e: (steps[0][e], steps[1][e]) for e in steps[0] | steps[1]}, kinds, shared, kept, found, firsts)


def test_kneser_ney_against_brute_force(spark):
    """Spark's counts and model equal plain loops; each class's probabilities sum to one after every word."""
    rng = random.Random(12)
    fit, more = [], []
    for i in range(500):
        w = [rng.choice(["alpha", "alphabet", "beta", "gamma", "delta", "kappa", "kap", "ñu"]) for _ in range(rng.randint(0, 60))]
        # Both classes have the two words equally often; only toxic ones have them in this order.
        w[30:30] = (["omega", "sigma"] if i % 4 == 0 else ["sigma", "omega"]) + (["idiot" + rng.choice("sen")] if i % 8 == 0 else [])
        fit.append((" ".join(w), int(i % 4 == 0)))
    more = [*ODD, *[random_text(rng, rng.randint(1, 60)) for _ in range(40)], "idiom omega alp " * 20]
    corpus = [t for t, _ in fit] + more
    docs = frame(spark, corpus)
    got = toxicity.kneser_ney(docs, spark.createDataFrame(fit, "text string, y int"))
    want = brute_kneser_ney(corpus, fit)
    assert got.kept == want.kept and got.pairs == want.pairs and got.firsts == want.firsts and {b"idi"} <= got.kept and (b"omega", b"sigma") in got.pairs
    assert all(want.steps[e] == x for e, x in got.steps.items()) and all(want.kinds[p] == x for p, x in got.kinds.items()) and all(want.shared[e] == x for e, x in got.shared.items())
    model, other = got.model(), want.model()
    assert model.steps == pytest.approx(other.steps) and model.pairs == pytest.approx(other.pairs) and model.rest == pytest.approx(other.rest) and model.after == pytest.approx(other.after)
    vocabulary = sorted({w for t in corpus for w in toxicity.words(t)})
    for v in [b"", b"omega", b"sigma", b"alpha", b"never seen"]:
        for y in (0, 1):
            assert sum(want.probability(y, v, w) for w in vocabulary) == pytest.approx(1)
    scorer = toxicity.Scorer(model)
    for t in rng.sample(corpus, 60):
        w = toxicity.words(t)
        logs = [math.log(want.probability(1, *p) / want.probability(0, *p)) for p in zip([b"", *w], w, strict=False)]
        assert scorer.ratio(t) == pytest.approx(sum(logs) / max(1, len(w)), abs=1e-9)
    assert scorer.ratio("omega sigma") > 0.5 > scorer.ratio("sigma omega")


def test_chains():
    assert toxicity.chain(b"abcdefghij") == [b"abc", b"abcde", b"abcdefg", b"abcdefghi", b"abcdefghij\0"]
    assert [toxicity.parent(e) for e in toxicity.chain(b"abcd")] == [b"", b"abc"] and toxicity.parent(b"ab\0") == b""


@pytest.mark.parametrize(("flush", "hot"), [(2_500_000, []), (1, []), (1, [b"the", b"of", b"never"]), (100, [b"the"])])
def test_contexts_of_all_documents(spark, flush, hot):
    """Distinct histories of every word of every document, over several flushes and split words, too; copies change nothing."""
    rng = random.Random(13)
    texts = [*ODD, *[random_text(rng, rng.randint(1, 200)) + " the of the" for _ in range(40)]] * 3
    want = Counter(w for _, w in {p for t in texts if t for w in [toxicity.words(t)] for p in zip([b"", *w], w, strict=False)})
    rows = toxicity.corpus_contexts(frame(spark, texts), [toxicity.word_hash(w) for w in hot], flush).collect()
    got: Counter = Counter()
    for r in rows:
        got[bytes(r.word)] += r.n
    assert got == want and (len(rows) > len(got)) == bool(hot)


def test_backoff_takes_unlabelled_documents(labelled):
    """Documents without a label change what is shared by both classes; repeated rows don't."""
    docs, labels = labelled
    more = docs.sparkSession.createDataFrame([(5000 + i, f"idiom{i} the{i} idiot of " * 3, "xx", "s", 0) for i in range(300)], DOCS)
    one, two = toxicity.train(docs, labels), toxicity.train(docs.unionByName(more), labels)
    assert one.steps.keys() == two.steps.keys() and one.steps[b"idi"] != two.steps[b"idi"]


def test_toxicity_edges(labelled):
    """Repeated ids and rows, very long texts, ties, extra columns of clashing names, one class only."""
    docs, labels = labelled
    spark = docs.sparkSession
    odd = spark.createDataFrame([(2000, "the of " * 200_000 + "idiot", None, None, None), (1, "the of", None, None, None), (1, "the of", None, None, None)], DOCS)
    extra = docs.unionByName(odd)
    for c in ("y", "part", "word", "score", "up", "n"):
        extra = extra.withColumn(c, F.lit("x"))
    model = toxicity.train(extra, labels.withColumn("text", F.lit("x")).unionByName(labels.limit(9).withColumn("text", F.lit(None).cast("string"))))
    out = toxicity.score_documents(extra, model).collect()
    assert len(out) == 607 and len({r.score for r in out if r.doc_id == 1}) <= 2
    assert toxicity.keep_clean(extra, model).columns == extra.columns
    single = toxicity.train(docs, labels.withColumn("toxic", F.lit(0)))
    assert {r.predicted for r in toxicity.score_documents(docs, single).collect()} == {0}


def test_language(labelled):
    docs, _ = labelled
    model = langid.train(docs)
    out = {r.doc_id: r for r in langid.predict_documents(docs, model).collect()}
    held = [i for i in range(600) if out[i].held_out]
    assert sum(out[i].lang_pred == ("xx" if i % 3 else "yy") for i in held) / len(held) >= 0.95
    assert [(out[i].lang_pred, out[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and out[None].held_out
    assert model.langs == ["xx", "yy"] and 0 < np.mean(model.weights == 0) < 1 and model.temperature > 0
    assert langid.identify(docs.limit(0)).count() == 0
    text = "aé b"
    at, counts = langid.grams(text)
    assert counts.sum() == len(text) + len(text) - 1 + len(text) - 2


def test_language_learns_from_training_rows_only(labelled):
    """Texts and languages of held-out rows, and texts without a language, don't change the model."""
    docs, _ = labelled
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.train(docs)
    again = langid.train(docs.withColumn("text", F.when(out, "quite other words").otherwise(F.col("text"))).withColumn("lang", F.when(out, "zz").otherwise(F.col("lang"))).unionByName(docs.sparkSession.createDataFrame([(7001 + i, "zzz qqq", None, None, None) for i in range(50)], DOCS)))
    assert again.langs == model.langs and np.array_equal(again.idf, model.idf) and np.array_equal(again.weights, model.weights) and again.temperature == model.temperature


def test_language_edges(labelled):
    """Repeated rows and ids, a very long text, one language only, extra columns of clashing names."""
    docs, _ = labelled
    odd = docs.sparkSession.createDataFrame([(3000, "wh the " * 200_000, "xx", None, None), (1, "the of", "xx", None, None), (1, "the of", "xx", None, None)], DOCS)
    more = docs.unionByName(odd)
    for c in ("f", "n", "c", "score", "lang_pred"):
        more = more.withColumn(c, F.lit("x"))
    rows = langid.identify(more).collect()
    assert len(rows) == docs.count() + 3 and [r.lang_pred for r in rows if r.doc_id == 3000] == ["xx"] and len({(r.lang_pred, r.score) for r in rows if r.doc_id == 1 and r.score < 1}) <= 1
    single = langid.identify(docs.withColumn("lang", F.lit("xx"))).collect()
    assert {r.lang_pred for r in single} == {"xx", "und"}


# 7 token files


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1023, 1024, 1025, 200_000):
        ids = rng.integers(0, 50_000, n).astype(np.uint32)
        ids[::97] = 4_000_000_000
        doc_ids, counts, back = token_files.load_file(token_files.dump_file([7, None], [n, 0], ids))
        assert (back == ids).all() and doc_ids == [7, None] and counts.tolist() == [n, 0]
    same = token_files.pack_blocks(np.full(1024, 9, np.uint32))
    assert len(same[0]) == token_files.BLOCK.size
    with pytest.raises(ValueError):
        token_files.load_file(b"x" * 64)


@pytest.mark.parametrize("file_ids", [1_000_000, 50])
def test_token_files(spark, file_ids):
    from tokenizers import Tokenizer

    path, pattern = token_files._defaults(None, None)
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    rng = random.Random(4)
    texts = [*ODD, *[random_text(rng, rng.randint(1, 200)) for _ in range(40)]]
    docs = frame(spark, texts).repartition(5)
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    folder, files = token_files.write_token_files(docs, file_ids=file_ids)
    assert sorted(tuple(r) for r in token_files.read_token_files(folder, files).collect()) == want
    assert token_files.read_token_files(*token_files.write_token_files(docs.limit(0))).count() == 0


def test_token_files_find_added_tokens(spark, tmp_path):
    """The query equals the plain call of a tokenizer as loaded, also where a text holds an added token."""
    from tokenizers import Tokenizer

    from vertexflow.llm import registry

    tok = Tokenizer.from_file(token_files._defaults(None, None)[0])
    texts = [*ODD, "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext|", "  <|endoftext|>  \n"]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert 50256 in tok.encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert sorted(tuple(r) for r in registry.op7_token_files(spark, f"file://{tmp_path}").collect()) == want


def test_token_files_edges(spark):
    """Null ids come first, rows of one id by their text's hash, repeated rows stay; extra columns may have any name."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files._defaults(None, None)[0])
    docs = edge_table(spark, ("start", "name", "content", "h"))
    got = sorted(tuple(r) for r in token_files.read_token_files(*token_files.write_token_files(docs, file_ids=3, added_tokens=True)).collect() if r.doc_id is not None)
    first = len(tok.encode("no id", add_special_tokens=False).ids) + 1
    assert [r[0] for r in got] == [1, 1, 1, 2, 3] and got[0][1] == first and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    assert sorted(r[2] for r in got) == sorted(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in ["one", "one", "other words", None, "mit license long " * 60_000])


# 10 BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("test", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(bpe.default_ranks_path()), special_tokens={})


def test_bpe_equals_the_library(spark, tiktoken_encoding):
    rng = random.Random(6)
    texts = [*ODD, *[random_text(rng, rng.randint(1, 300)) for _ in range(60)]]
    out = {r.doc_id: r for r in bpe.encode_documents(frame(spark, texts), with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = tiktoken_encoding.encode_ordinary(t or "")
        assert out[i].ids == ids and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_prefix_table_appends_and_edits(tiktoken_encoding):
    model = bpe.PrefixBPE(bpe.load_ranks(bpe.default_ranks_path()))
    rng = random.Random(7)
    single = tiktoken_encoding._encode_single_piece
    for _ in range(60):
        data = bytes(rng.choice(b"abcdethinosr") for _ in range(rng.randint(1, 60)))
        assert model.encode(data) == single(data)
        table = bpe.PrefixTable(model, data[:5])
        table.append(data[5:])
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        new = bytes(rng.choice(b"the ") for _ in range(rng.randint(0, 5)))
        table.replace(a, b, new)
        data = data[:a] + new + data[b:]
        assert table.last == bpe.PrefixTable(model, data).last and (not data or table.encoding() == single(data))
    long = bpe.PrefixTable(model, b"abcdefgh" * 400)
    assert long.replace(10, 12, b"zz") < 400 and long.last == bpe.PrefixTable(model, long.data).last


def test_narrow_pattern_matches_the_same():
    cache = pieces.PieceCache(bpe.default_pattern(), lambda m: m.encode())
    assert cache.narrow is not None
    rng = random.Random(8)
    for _ in range(500):
        t = "".join(rng.choice(list("aZé9!' \n\t.sß_[")) for _ in range(30))
        assert not cache.beyond(t) and cache.narrow(t) == cache.full(t)
    for c in "²½ªµ\x85 \x1c漢×÷":
        assert cache.beyond(c)
