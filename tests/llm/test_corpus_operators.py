"""Operators on whole corpora and the pipeline, against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from vertexflow.functions import tables
from vertexflow.llm import common, components, decontam, repeats, sharding, simhash, toxicity
from vertexflow.llm.registry import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def some_words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(rng):
    """Copies, near copies, shared passages, repeats within a text, odd texts, repeated rows and ids, null ids."""
    passage, line = some_words(rng, 60), some_words(rng, 45)
    rows = [(i, some_words(rng, rng.randint(1, 150))) for i in range(40)]
    rows += [(40 + i, rows[i][1]) for i in range(6)] + [(50 + i, rows[7][1]) for i in range(5)]
    rows += [(60 + i, f"{some_words(rng, 30)} {passage} {some_words(rng, i)}") for i in range(6)]
    rows += [(70, line + " " + line), (71, "é" * 150 + passage[:90] + "ß" * 150), (72, "é" * 150), (73, "a" * 450), (74, "a" * 199), (75, "a" * 200)]
    base = some_words(rng, 120).split()
    for i in range(12):
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        rows.append((80 + i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "x"), (3, rows[3][1]), (3, "another text of id three"), (None, rows[9][1]), (None, "no id"), (104, passage[:200]), (105, passage[1:200])]
    return rows


# 3 repeats


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if n[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("long_group", "buffer", "seed"), [(50_000, None, 1), (1, None, 2), (50_000, 300, 3)])
def test_repeats(spark, monkeypatch, long_group, buffer, seed):
    rows = corpus(random.Random(seed))
    if buffer:
        # the cut of long texts, in this process: the workers have the module's own value
        texts = [(t or "").encode() for _, t in rows]
        whole = sorted(_anchor_rows(texts))
        monkeypatch.setattr(repeats, "BUFFER", buffer)
        assert sorted(_anchor_rows(texts)) == whole
        return
    out = repeats.remove_repeats(frame(spark, rows).repartition(5), long_group=long_group)
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows]), strict=True)), key=repr)


def test_repeats_of_texts_longer_than_a_buffer(spark):
    """A passage across the cut of two texts of 2.1 MB is found as a whole, and nothing else goes."""
    rng = np.random.default_rng(9)
    own = ["".join(map(chr, rng.integers(97, 123, 2_100_000))) for _ in range(2)]
    passage = "".join(map(chr, rng.integers(97, 123, 700)))
    at = [repeats.BUFFER - 300, repeats.BUFFER - 650]
    texts = [t[:a] + passage + t[a:] for t, a in zip(own, at, strict=True)]
    out = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, [(1, texts[0]), (2, texts[1]), (3, passage[:199])])).collect()}
    for i in (1, 2):
        # bytes next to the passage may continue it by chance
        t, a = own[i - 1], at[i - 1]
        extra = out[i].n_removed - 700
        assert out[i].n_spans == 1 and 0 <= extra <= 4
        assert out[i].kept_sha256 in {hashlib.sha256((t[: a - k] + t[a + extra - k :]).encode()).hexdigest() for k in range(extra + 1)}
    assert out[3].n_removed == 0


def _anchor_rows(texts, length=200):
    """(text, place, offset) of every string, through the segments."""
    out = set()
    for buf, cuts, which, begins in repeats._segments(texts, length):
        for o, a, lo, hi in zip(*(x.tolist() for x in repeats.anchors(buf, cuts, length)), strict=True):
            out |= {(which[o], a - cuts[o][0] + begins[o], k) for k in range(lo, hi + 1)}
    assert Counter(i for i, _, _ in out) == {i: len(t) - length + 1 for i, t in enumerate(texts) if len(t) >= length}
    return out


def test_repeats_edges(spark):
    empty = frame(spark, [(1, "x")]).limit(0)
    assert repeats.remove_repeats(empty).count() == 0
    docs = frame(spark, [(1, "ab" * 150), (2, "y " + "ab" * 150), (3, None), (4, "plain")])
    kept = {r.doc_id: (r.text, r.n_chars) for r in repeats.deduplicate(docs).collect()}
    assert kept == {1: ("", 0), 2: ("y ", 2), 3: (None, None), 4: ("plain", 5)}
    for names in ({"lang": "runs", "source": "th"}, {"lang": "row", "source": "id"}, {"lang": "run_id", "source": "run_th"}, {"lang": "vf_id", "source": "vf_own_id"}):
        clash = docs.withColumnsRenamed(names)
        found = repeats.deduplicate(clash)
        assert found.columns == clash.columns and {r.doc_id: (r.text, r[3], r[2]) for r in found.collect()} == {i: (t, "s", "en") for i, (t, _) in kept.items()}
    with pytest.raises(ValueError):
        repeats.covered_runs(docs, 50)


def test_interleave_orders_and_counts():
    rng = np.random.default_rng(4)
    group = rng.integers(0, 4, 200)
    context = rng.integers(0, 2, (200, 21), dtype=np.uint8)
    context[::3] = context[0]
    order, common = repeats.interleave(group, context)
    keys = [(int(group[i]), bytes(context[i])) for i in order]
    assert keys == sorted(keys)
    for (g, a), (k, b), c in zip(keys, keys[1:], common[1:].tolist(), strict=False):
        assert c == (-1 if g != k else next((i for i in range(21) if a[i] != b[i]), 21))


# 4 SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, distance=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("long_list", [256, 1])
def test_near_duplicates(spark, long_list):
    rows = corpus(random.Random(11))
    fps = [brute_fingerprint(t) for _, t in rows]
    assert fps == [simhash.fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = {r: min((i for (i, _), x in zip(rows, roots, strict=True) if x == r and i is not None), default=None) for r in set(roots)}
    want = sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True)), key=repr)
    assert sorted(map(tuple, simhash.near_duplicates(frame(spark, rows), long_list=long_list).collect()), key=repr) == want
    kept = [r.doc_id for r in simhash.keep_one(frame(spark, rows), long_list=long_list).collect()]
    assert sorted(kept, key=repr) == sorted(least.values(), key=repr)
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_links_of_dense_balls(spark):
    """Many fingerprints around one: long posting lists are split, and no link is lost."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(500)} | {rng.getrandbits(64) for _ in range(100)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), long_list=20)
    found = {r.node: r.root for r in components.components(links).collect()}
    roots = brute_components(fps)
    groups: dict = {}
    for f, r in zip(signed, roots, strict=True):
        groups.setdefault(r, set()).add(f)
    got: dict = {}
    for f in signed:
        got.setdefault(found.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    assert len(simhash.index_masks()) == 35 and all(len(simhash.split_masks(m)) == 56 for m in simhash.index_masks())


def test_components(spark):
    links = [(5, 9), (9, 2), (7, 8), (8, 8), (2, 5), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35), (40, 39), (39, 38)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {2: 2, 5: 2, 9: 2, 7: 7, 8: 7, 30: 30, 31: 30, 32: 30, 33: 30, 34: 30, 35: 30, 38: 38, 39: 38, 40: 38}
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("op", ["near_duplicates", "keep_one"])
def test_postings_are_not_broadcast(spark, tmp_path, monkeypatch, op):
    frame(spark, corpus(random.Random(3))).write.parquet(f"{tmp_path}/d")
    plans, write = {}, simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name: plans.update({name: df._jdf.queryExecution().sparkPlan().toString()}) or write(df, name))
    getattr(simhash, op)(spark.read.parquet(f"{tmp_path}/d"))
    assert "Generate explode" in plans["postings"] and "SortMergeJoin" in plans["postings"] and "BroadcastHashJoin" not in plans["postings"]


def test_components_of_a_hub(spark, monkeypatch):
    """A hub's links meet the least node in their own tasks; results are the same."""
    monkeypatch.setattr(tables, "LEAST_HEAVY", 3)
    pairs = [(500, i) for i in range(400, 450)] + [(450 + i, 451 + i) for i in range(20)] + [(7, 500), (90, 91)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 7 for i in [7, 500, *range(400, 450)]}, **{450 + i: 450 for i in range(21)}, 90: 90, 91: 90}


def test_keep_one_with_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(tables, "LEAST_HEAVY", 3)
    rows = [(i, "the same long text of copies" if i % 2 else f"quite another text number {i} {i * i} {i + 7}") for i in range(40)] + [(3, "the same long text of copies"), (2, "w " * 100_000 + "end")]
    docs = frame(spark, rows)
    want = sorted(simhash.keep_one(docs).select("doc_id", "text").collect())
    assert [r.doc_id for r in want if r.text.startswith("the same")] == [1]
    for names in (("fp", "th"), ("id", "row"), ("kept_id", "kept_th"), ("vf_id", "vf_own_id"), ("group", "m")):
        clash = docs.withColumnsRenamed(dict(zip(("lang", "source"), names, strict=True)))
        out = simhash.keep_one(clash)
        assert out.columns == clash.columns and sorted(out.select("doc_id", "text").collect()) == want
    near = simhash.near_duplicates(docs).collect()
    assert len(near) == len(rows) and {r.component_id for r in near if r.doc_id % 2} == {1}


# 9 sharding


def test_sharding(spark):
    rows = corpus(random.Random(21)) + [(200 + i, "the same text") for i in range(60)]
    out = sharding.assign(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.size) for r in out if r.doc_id is not None) == sorted((i, len((t or "").encode()) + 1) for i, t in rows if i is not None)
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    import zlib

    assert {r.text_crc32 for r in out} == {zlib.crc32((t or "").encode()) for _, t in rows}
    by_text: dict = {}
    for r in out:
        by_text.setdefault((r.text_crc32, r.size), set()).add(r["shard"])
    big = max(by_text.values(), key=len)
    assert len(big) <= 60 // (len(rows) // 8) + 2 and sum(len(s) > 1 for s in by_text.values()) <= 4
    assert sharding.assign(frame(spark, rows).limit(0)).count() == 0


def test_sharding_swaps_between_closed_shards(spark):
    """Every text occurs twice, so no shard has an unlinked row."""
    out = sharding.assign(frame(spark, [(i, f"text {i // 2}") for i in range(1600)])).collect()
    assert set(Counter(r["shard"] for r in out).values()) == {200}
    by_text: dict = {}
    for r in out:
        by_text.setdefault((r.text_crc32, r.size), set()).add(r["shard"])
    cut = sum(len(s) > 1 for s in by_text.values())
    print("cut", cut, "of", len(by_text))
    assert cut <= 0.2 * len(by_text)


def cuts(out):
    by_text: dict = {}
    for r in out:
        by_text.setdefault((r.text_crc32, r.size), set()).add(r["shard"])
    return sum(len(s) - 1 for s in by_text.values())


def greedy_cut(sizes, shards=8):
    """Groups, the largest first, into the emptiest shards of equal room."""
    room, cut = [-(-sum(sizes) // shards)] * shards, 0
    for n in sorted(sizes, reverse=True):
        parts = 0
        while n:
            s = max(range(shards), key=lambda i: room[i])
            k = min(n, room[s])
            room[s] -= k
            n -= k
            parts += 1
        cut += parts - 1
    return cut


def test_sharding_of_a_hot_group_when_all_are_linked(spark, monkeypatch):
    """One text half of all rows, the others about 31 times each, no unlinked row."""
    monkeypatch.setattr(tables, "LEAST_HEAVY", 10)
    sizes = [400] + [31] * 12 + [28]
    rows = [f"text {g}" for g, n in enumerate(sizes) for _ in range(n)]
    random.Random(3).shuffle(rows)
    docs = frame(spark, list(enumerate(rows)))
    for c in ("g", "shard", "linked", "rid", "n", "to"):
        docs = docs.withColumn(c, F.lit("x"))
    out = sharding.assign(docs).collect()
    assert set(Counter(r["shard"] for r in out).values()) == {100}
    print("cut", cuts(out), "greedy", greedy_cut(sizes))
    assert cuts(out) == sharding.cut_links(spark.createDataFrame([(r.text_crc32, r.size, r["shard"]) for r in out], "text_crc32 long, size long, shard int")) <= 2 * greedy_cut(sizes)


def test_quotas():
    wanted, spare = {(0, 1): 10, (1, 0): 4, (2, 1): 3, (1, 2): 5}, [5, 6, 5]
    allowed, back = sharding.quotas(wanted, spare)
    gain, leave = Counter(), Counter()
    for (a, b), k in allowed.items():
        gain[a] -= k
        gain[b] += k
        leave[a] += k
        assert 0 < k <= wanted[a, b]
    for a, b, k in back:
        gain[a] -= k
        gain[b] += k
        leave[a] += k
    assert not any(gain.values()) and all(leave[s] <= max(spare[s], sum(k for (a, _), k in allowed.items() if a == s)) for s in range(3))
    assert all(sum(k for (_, b), k in allowed.items() if b == s) <= spare[s] for s in range(3)) and sum(allowed.values()) == 4 + 6 + 5


# The pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(31)
    rows = [(i, some_words(rng, rng.randint(30, 120)) + (" idiot moron scum" * 3 if i % 5 == 0 else "")) for i in range(300)]
    bench = [(1, some_words(rng, 30)), (2, "short item")]
    rows += [(300, rows[1][1]), (301, rows[2][1] + " tail"), (302, f"clean start {bench[0][1]} end"), (303, None), (304, "")]
    shared = some_words(rng, 60)
    rows += [(310 + i, f"{some_words(rng, 40)} {shared} {some_words(rng, 40)}") for i in range(3)]
    labels = [(i, int(i % 5 == 0)) for i in range(300)]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    # brute force, stage by stage
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scorer = toxicity.Scorer(model)
    left = [(i, t) for i, t in rows if scorer.score(t) < 0.5]
    assert not any(i < 300 and i % 5 == 0 for i, _ in left) and len(left) >= 245
    roots = brute_components([brute_fingerprint(t) for _, t in left])
    least = {}
    for (i, _), r in zip(left, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    left = [(i, t) for i, t in left if i in set(least.values())]
    gone = [t for _, t in left]
    data = [(t or "").encode() for t in gone]
    n = Counter(b[s : s + 200] for b in data for s in range(len(b) - 199))
    cleaned = []
    for (i, t), b in zip(left, data, strict=True):
        mask = np.ones(len(b), bool)
        for s in range(len(b) - 199):
            if n[b[s : s + 200]] > 1:
                mask[s : s + 200] = False
        cleaned.append((i, None if t is None else bytes(np.frombuffer(b, np.uint8)[mask]).decode()))
    found = decontam.matchers([(str(i), t) for i, t in bench])
    final = {i: t for i, t in cleaned if not decontam.find_hits(decontam.words(t), found)[0]}
    assert 302 not in final and 300 not in final and 1 in final
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in final.items()} and len(out) == len(final)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "decontamination", "tokens"] and corpus_pipeline.ORACLE_SQL is None
    odd = docs.unionByName(frame(spark, [(None, "a text without an id"), (1, rows[1][1]), (1, rows[1][1]), (305, "again " * 50_000)]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = None
        for names in (("lang", "source"), ("fp", "th"), ("row", "id"), ("runs", "pass"), ("vf_id", "vf_own_id")):
            extra = odd.withColumnsRenamed(dict(zip(("lang", "source"), names, strict=True)))
            found = stage(spark, extra, sf)
            assert found.columns == extra.columns, name
            kept = sorted(map(tuple, found.collect()), key=repr)
            want = want or kept
            assert kept == want and any(r[0] is None for r in kept), name
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))


def test_anchors_memory():
    """What is held at a time beside the text's bytes: 52 bytes for each before, when all places' numbers were held together."""
    buf = np.random.default_rng(3).bytes(1_000_000)
    tracemalloc.start()
    repeats.anchors(buf, [(a, a + 2000) for a in range(0, len(buf), 2000)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * len(buf)


def test_workers_give_memory_back(spark):
    """Arrow's own pool keeps what a task has freed; workers use the system's, and small batches while a table is staged."""

    def run(batches):
        for batch in common.sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([pa.default_memory_pool().backend_name] * batch.num_rows), pa.array([batch.num_rows] * batch.num_rows)], ["pool", "n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    common.ship(spark)
    got, _ = common.staged(spark.range(5000, numPartitions=1).mapInArrow(run, "pool string, n long"), "pools")
    assert {r.pool for r in got.distinct().collect()} == {"system"} and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
