"""Hard negatives, token files and the Merkle manifest: brute force, round trips, edge cases."""
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

EDGE = [None, "", " \n\t", "a", "Ünï ÇÖDÉ " * 40, "X y " * 3000, "Same text", "Same text", "<|endoftext|> it's"]
VECTORS = "vec_id long, label int, embedding array<float>"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- hard negatives ---------------------------------------------------------------

def mined_brute(rows, positives=5, negatives=5):
    import math
    kept = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, x in kept:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, v)), i, y) for i, y, v in kept)
        for s, i, _ in [r for r in scored if r[2] == label and r[1] != a][:positives]:
            found = [r for r in scored if r[2] != label and -80 * s <= -100 * r[0] <= -100 * s][:negatives]
            out += [(a, i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **params):
    from glucoframe.llm.hard_negatives import hard_negatives
    vectors = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("own")).withColumn("anchor_no", F.lit(1))
    got = hard_negatives(vectors, F.col("vec_id") % 100 == 0, **params)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def clustered(n, seed, step=10):
    """Vectors in tight clusters, each of mixed labels, with equal vectors among them."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 8))
    rows = []
    for i in range(n):
        v = centres[i % 6] + 0.05 * rng.standard_normal(8) * (i % 4 > 0)
        rows.append((i * step, int(rng.integers(0, 3)) if i % 3 else 0, [float(np.float32(x)) for x in v]))
    return rows


@pytest.mark.parametrize("params", [{}, {"block": 4}, {"block": 4, "wave_bytes": 800}])
def test_hard_negatives_equal_brute_force(spark, params):
    rows = clustered(400, 3)
    want = mined_brute(rows)
    assert len(want) > 300
    assert mined(spark, rows, **params) == want


def test_hard_negatives_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (None, 1, [1.0, 2.0]), (100, None, [1.0, 2.0]), (200, 1, None), (300, 1, [None, 1.0]), (400, 1, [nan, 1.0]),
            (500, 2, [inf, 1.0]), (1, 1, [1.0, 2.0]), (2, 1, [1.0, 2.0]), (3, 2, [0.9, 1.9]), (4, 2, [0.9, 1.9]), (5, 2, []), (600, 2, []),
            (6, 1, [1.0]), (7, 3, [1.0, 1.5, 9.0]), (700, 5, [-1.0, -2.0]), (8, 5, [1.0, 2.0]), (800, 9, [0.0, 0.0]), (9, 9, [5.0, 5.0])]
    assert mined(spark, rows) == mined_brute(rows)
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []


def test_hard_negatives_exact_beyond_doubles(spark):
    from glucoframe.llm.hard_negatives import products
    big = float(2 ** 22 + 1)  # scores of about 2 ** 60
    rows = [(0, 0, [big, 1.0]), (1, 0, [big, 1 / 256]), (2, 1, [big, 0.0]), (3, 1, [big, -1 / 256]), (100, 1, [big, 2 / 256])]
    want = mined_brute(rows)
    assert len({r[5] for r in want}) > 1 and mined(spark, rows) == want
    with pytest.raises(OverflowError):
        products(np.full((1, 2), 2.0 ** 40), np.full((1, 2), 2.0 ** 40))


def test_spanning_tree_is_minimal_and_bounds_spare_products():
    import pandas as pd
    from glucoframe.llm.hard_negatives import Search, Tree, Windows, spanning_tree
    rng = np.random.default_rng(1)
    # tight clusters: most edges are far shorter than the anchors
    centres = rng.standard_normal((5, 16)) * 200
    x = np.floor(np.repeat(centres, 20, axis=0) + rng.standard_normal((100, 16)) * 3)
    order, parents, edges = spanning_tree(x)
    assert sorted(order) == list(range(100)) and all(p < i for i, p in enumerate(parents))
    full = np.vstack([np.zeros(16), x])
    d = np.sqrt(((full[:, None] - full[None]) ** 2).sum(-1))
    group, total = list(range(101)), 0.0  # Kruskal
    for i, j in sorted(((i, j) for i in range(101) for j in range(i)), key=lambda p: d[p]):
        if group[i] != group[j]:
            total += d[i, j]
            group = [group[j] if g == group[i] else g for g in group]
    assert abs(edges.sum() - total) < 1e-6
    table = pd.DataFrame({"anchor_no": order, "vec_id": order, "label": 0, "vector": list(x[order]), "node": range(100), "parent": parents, "edge": edges})
    rows = np.floor(np.repeat(centres, 200, axis=0) + rng.standard_normal((1000, 16)) * 3)
    search = Search([Tree(table)], {i: Windows([-np.inf], [np.inf], 5) for i in range(100)}, False)
    for i in range(0, 1000, 100):  # the windows rise with what is known
        at = np.arange(i // 100, 1000, 10)
        search.add(1000 + at, np.ones(100, int), rows[at])
    scores = x @ rows.T
    for i in range(100):
        want = sorted((-int(s), 1000 + r) for r, s in enumerate(scores[i]))[:5]
        assert search.windows[i].best[0] == want
    assert search.bounded > 90_000 and search.rescored < 0.4 * search.bounded


# ---- Merkle manifest --------------------------------------------------------------

def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes, fan_out):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + fan_out]) for i in range(0, len(out[-1]), fan_out)])
    return out


def path(levels, i, fan_out):
    out = []
    for level in levels[:-1]:
        first = i - i % fan_out
        out.append((level[first:i], level[i + 1:first + fan_out]))
        i //= fan_out
    return out


def manifest_brute(rows, fan_out=8):
    trees = defaultdict(list)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text, lang, source, n_chars in rows:
        changed = text
        if text is not None and zlib.crc32(("-" if doc_id is None else str(doc_id)).encode()) % 3 == 0:
            changed = text.translate(low)
        trees[lang].append(((doc_id is not None, doc_id or 0), leaf(doc_id, source, lang, n_chars, text), doc_id, leaf(doc_id, source, lang, n_chars, changed)))
    langs = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: levels([r[1] for r in sorted(trees[g], key=lambda r: r[:2])], fan_out) for g in langs}
    top = levels([built[g][-1][0] for g in langs], fan_out)
    out = []
    for k, g in enumerate(langs):
        for i, (_, own, doc_id, cur) in enumerate(sorted(trees[g], key=lambda r: r[:2])):
            steps = path(built[g], i, fan_out) + path(top, k, fan_out)
            for before, after in steps:
                cur = H(*before, cur, *after)
            proof = H(*(d for before, after in steps for d in before + after))
            out.append((doc_id, own, built[g][-1][0], top[-1][0], proof, cur, cur == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(spark, rows, **params):
    from glucoframe.llm.merkle import manifest
    docs = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit("own")).withColumn("place", F.lit(1)).withColumn("tree", F.lit(2))
    return sorted((tuple(r) for r in manifest(docs, **params).collect()), key=str)


def test_manifest_equals_brute_force(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(EDGE)]
    rows += [(1000 - i, f"Text {i % 7}", f"l{i % 11}", "s", i) for i in range(200)]  # eleven languages: two levels above
    rows += [(None, "No id", "l0", "s", 1), (5, "Twice", "l0", "s", 1), (5, "Twice", "l0", "s", 1), (5, "other", "l0", "t", 2)]
    rows += [(9, "Alone", "é", "s", 1), (9, "Alone", "", "s", 1)]
    got = manifest_rows(spark, rows)
    assert got == manifest_brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_many_superblocks_and_a_hot_language(spark):
    rows = [(i, f"Doc {i}", "hot" if i % 10 else f"cold{i % 30}", "s", i) for i in range(700)]
    # superblocks of 9 and 8 leaves: up to five levels above them
    for fan_out, local in ((3, 2), (2, 3), (8, 1)):
        assert manifest_rows(spark, rows, fan_out=fan_out, local=local) == manifest_brute(rows, fan_out)


def test_manifest_small_tables(spark):
    assert manifest_rows(spark, []) == []
    one = [(3, "One", "en", "s", 3)]
    assert manifest_rows(spark, one) == manifest_brute(one)
    eight = [(i, "T", "en", "s", 1) for i in range(8)]
    nine = [(i, "T", "en", "s", 1) for i in range(9)]
    assert manifest_rows(spark, eight) == manifest_brute(eight)
    assert manifest_rows(spark, nine) == manifest_brute(nine)


# ---- token files ------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return path, lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_token_files_round_trip(spark, make, vocabulary, tmp_path):
    from glucoframe.llm.token_files import TokenFiles
    path, encode = vocabulary
    texts = [*EDGE, "word " * 5000, *(f"text number {i}" for i in range(300))]
    ids = [(37 * i) % 997 for i in range(len(texts))]
    docs = make(texts, ids).withColumn("ids", F.lit("own")).withColumn("start", F.lit(1)).repartition(7)
    files = TokenFiles(spark, str(tmp_path / "t")).write(docs, path, piece=100)
    rows = sorted(files.rows().collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    stream = np.concatenate([r["ids"] for r in rows]).tolist()
    want = sorted(zip(ids, texts))
    assert stream == [x for _, t in want for x in encode(t)]
    at, expected = 0, []
    for i, t in want:
        tokens = encode(t)
        expected.append((i, at, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        at += len(tokens)
    assert sorted(map(tuple, files.digests().collect())) == expected
    # a document by its id
    assert sum((list(r["ids"]) for r in sorted(files.lookup(ids[0], ids[9]).collect(), key=lambda r: r["start"])), []) == [
        x for i, t in want if i in (ids[0], ids[9]) for x in encode(t)]


def test_token_files_are_pruned_by_metadata(spark, make, vocabulary, tmp_path):
    from pyarrow import orc
    from glucoframe.llm.token_files import TokenFiles
    path, _ = vocabulary
    docs = make([f"some text {i}" for i in range(6000)], list(range(0, 12000, 2))).coalesce(2)
    files = TokenFiles(spark, str(tmp_path / "t")).write(docs, path, row_group=1000)
    names = sorted((tmp_path / "t" / "ids").glob("*.orc"))
    assert len(names) > 1
    first = orc.ORCFile(str(names[0]))
    assert first.row_index_stride == 1000 and first.compression == "ZSTD"
    # the Bloom filters of doc_id take room that files without them don't need
    plain = tmp_path / "plain"
    spark.read.orc(str(names[0])).coalesce(1).write.option("compression", "zstd").option("orc.row.index.stride", 1000).orc(str(plain))
    assert names[0].stat().st_size > next(plain.glob("*.orc")).stat().st_size
    found = files.lookup(4000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(doc_id,4000)" in plan
    assert [r["doc_id"] for r in found.collect()] == [4000]
    assert files.lookup(4001).count() == 0  # between ids: only the Bloom filter can tell


def test_token_files_empty_and_repeated_rows(spark, make, vocabulary):
    from glucoframe.llm.token_files import token_digests
    path, encode = vocabulary
    assert token_digests(make(["x"]).limit(0), path).collect() == []
    got = sorted(tuple(r) for r in token_digests(make(["b b", "b b", "b b"], [4, 4, 4]), path).collect())
    n = len(encode("b b"))
    assert [r[:3] for r in got] == [(4, 0, n), (4, n, n), (4, 2 * n, n)] and len({r[3] for r in got}) == 1
    null = spark.createDataFrame([(None, None), (1, "a")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in token_digests(null, path).orderBy("start").collect()] == [(None, 0, 1), (1, 1, len(encode("a")))]


def test_crc_of_joined_parts():
    from glucoframe.llm.token_files import ZeroBytes
    rng = np.random.default_rng(3)
    parts = [(rng.bytes(a), rng.bytes(b)) for a, b in ((0, 0), (0, 5), (7, 0), (13, 4096), (1, 100_001), (50, 1 << 20))]
    moved = ZeroBytes().moved(np.array([zlib.crc32(x) for x, _ in parts]), np.array([len(y) for _, y in parts]))
    assert [int(m) ^ zlib.crc32(y) for m, (_, y) in zip(moved, parts)] == [zlib.crc32(x + y) for x, y in parts]
