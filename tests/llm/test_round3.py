"""Spelling variants, line dedup and the Merkle manifest against brute force on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from brookmart.llm import line_dedup, merkle, queries, spelling

#: Clashing names: columns that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long, n long, word string, h1 long, keep string, key string"
TABLE = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    letters = "abcdefghéü"
    stock = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    stock += [w[:i] + rng.choice(letters) + w[i + rng.randint(0, 1):] for w in stock[:40] for i in (0, 3, len(w))]
    weights = [rng.choice([1, 1, 2, 30]) for _ in stock]
    boiler = ["All rights reserved.", "  all Rights RESERVED.\t", "é", "x", "", "   "]
    made = [
        (None, "no key at all"), (1, None), (2, ""), (3, "\n"), (4, "one\n\ntwo\n"), (4, "one\n\ntwo\n"), (4, "another text of the same key"),
        (5, "\x1cx\x85\nX\n x \n x"), (6, "a" * 200_000 + "\n" + "All rights reserved.\n" * 3_000), (7, "×÷abcdefz Šabcdefz abcdefz_abcdefz"),
    ]
    for i in range(120):
        lines = [" ".join(rng.choices(stock, weights, k=rng.randint(1, 12))) for _ in range(rng.randint(0, 6))]
        lines += rng.choices(boiler, k=rng.randint(0, 4))
        rng.shuffle(lines)
        text = "\n".join(lines)
        made.append((100 + i, text.upper() if i % 9 == 0 else text))
    langs = ["en", "en", "en", "en", "de", None, "", "-", "é"]
    return [(k, t, rng.choice(langs) if k != 4 else "en", rng.choice([None, "web"]) if k != 4 else None, rng.choice([None, 5, 2**63 - 1]) if k != 4 else 3, "g", 0, 0, "w", 1, "k", "y") for k, t in made]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Many small partitions, which stay as they are: groups reach over their borders."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))


@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_line_dedup(docs, rows, min_docs):
    documents = {r[:2] for r in rows}
    count = collections.Counter(k for _, t in documents for k in {line_key(x) for x in (t or "").split("\n")} if k)
    want = []
    for k, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[line_key(x)] < min_docs or not line_key(x)]
        want.append((k, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert bag(line_dedup.dedup(docs, min_docs=min_docs), "doc_id", "n_lines", "n_dropped", "kept") == sorted(want, key=repr)


def test_line_dedup_of_short_keys_and_nothing(docs, rows, empty):
    dropped = {k for k, t, *_ in rows if t and any(len(line_key(x)) >= 3 and sum(line_key(x) in {line_key(y) for y in (u or "").split("\n")} for _, u, *_ in rows) >= 10 for x in t.split("\n"))}
    got = {r.doc_id for r in line_dedup.dedup(docs, min_letters=3).collect() if r.n_dropped}
    assert got == dropped and dropped
    assert line_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("at", [[0], [7], [8], [0, 1, 2], [63, 64, 1000], list(range(500))])
def test_keep_bitmaps_round_trip(at):
    keep = line_dedup.unpack_keep(line_dedup.pack_keep(np.array(at)), 1200)
    assert np.flatnonzero(~keep).tolist() == at
    assert line_dedup.unpack_keep(None, 3).all()
    short = line_dedup.unpack_keep(line_dedup.pack_keep(np.array(at)), at[-1] + 1)
    assert np.flatnonzero(~short).tolist() == at


@pytest.mark.parametrize("cuts", range(8))
def test_streamed_runs_of_any_partition_cut(cuts):
    """However sorted rows are cut into partitions and batches, runs are decided or left open, once."""
    import pyarrow as pa

    rng = random.Random(cuts)
    rows = sorted((h, h, d, d, at) for h in range(12) for d in range(rng.choice([1, 2, 3, 6, 20])) for at in range(rng.randint(1, 3)))
    edges = sorted([0, len(rows), *rng.choices(range(len(rows)), k=cuts)])
    out, counts = [], collections.Counter()
    for a, b in zip(edges, edges[1:]):  # noqa: B905
        part = rows[a:b]
        sizes = rng.choice([1, 3, 50])
        batches = [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*part[i:i + sizes], strict=True)], names=list("abcde")) for i in range(0, len(part), sizes)]
        out += [tuple(x.values()) for b in line_dedup._streamed(4)(iter(batches)) for x in b.to_pylist()]
    wanted = {h for h in range(12) if len({r[2] for r in rows if r[0] == h}) >= 4}
    by = collections.defaultdict(set)
    for h, _, d, _, at, is_open in out:
        if is_open:
            by[h].add("enough" if at < 0 else d)
    found = {h for h, ds in by.items() if "enough" in ds or len(ds) >= 4}
    got = [r[:5] for r in out if r[4] >= 0 and (not r[5] or r[0] in found)]
    assert sorted(got) == [r for r in rows if r[0] in wanted]
    assert max(counts.values(), default=1) == 1


def words_of(rows):
    n = collections.Counter()
    for k, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 6:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_variants(docs, rows, empty):
    n = words_of(rows)
    want = variants(n)
    assert sum(x[1] is not None for x in want) > 5 and sum(x[4] for x in want) > 20 and any(c > "\x7f" for w in n for c in w)
    assert bag(spelling.variants(docs), *NAMES) == want
    assert spelling.variants(empty).count() == 0


def test_spelling_chains_and_ties(spark):
    """Forms of forms, equal counts, and words that hashing the alphabet makes equal."""
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 130, "aaabbb": 700, "aabbbb": 5000, "zzzzzz": 5, "zzzzzy": 50, "zzzzzx": 50, "abcdefg": 9, "qqqqqqé": 9, "qqqqqq": 45, "qqqqqqê": 45}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    want = variants(n)
    assert ("aaaaaa", "aaaaab", "aabbbb", 5, 1, 25) in want and ("zzzzzz", "zzzzzx", "zzzzzx", 5, 2, 50) in want
    assert bag(spelling.group_variants(words), *NAMES) == want


def test_neighbourhood_holds_every_reduced_edit():
    rng = random.Random(1)
    for symbols in (2, 8, 13):
        for _ in range(60):
            word = "".join(rng.choice("abcéxyz") for _ in range(rng.randint(1, 9)))
            code = spelling.reduced([word, word[::-1]], symbols)
            keys = {int(h) for column in spelling.neighbourhood(code, symbols) for h in column[0]}
            code = code[0].tolist()
            want = {tuple(code)}
            for i in range(len(code) + 1):
                want |= {(*code[:i], s, *code[i:]) for s in range(1, symbols + 1)}
                if i < len(code):
                    want |= {(*code[:i], s, *code[i + 1:]) for s in range(1, symbols + 1)} | {(*code[:i], *code[i + 1:])}
            assert keys == {int(spelling.reduced_hashes(np.array([c], np.uint64).reshape(1, -1))[0]) for c in want} and len(keys) == len(want)


def tree_root(digests, fan=2):
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + fan])) for i in range(0, len(below), fan)])
    return levels


def proof_of(levels, at, fan=2):
    out = []
    for below in levels[:-1]:
        first = at - at % fan
        out += [x for i, x in enumerate(below[first:first + fan], first) if i != at]
        at //= fan
    return out


def plain_manifest(rows, fan=2):
    """Each changed row is put in place and the whole tree built again."""
    def leaf(k, text, lang, source, n_chars):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (k, source, lang, n_chars, text)))

    own = sorted((r[:5] for r in rows), key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(*r)))
    langs = list(dict.fromkeys(r[2] for r in own))

    def whole(leaves):
        trees = [tree_root([d for d, r in zip(leaves, own, strict=True) if r[2] == x], fan) for x in langs]
        return trees, tree_root([t[-1][0] for t in trees], fan)

    leaves = [leaf(*r) for r in own]
    trees, top = whole(leaves)
    out, place = [], collections.Counter()
    for i, r in enumerate(own):
        tree = trees[langs.index(r[2])]
        proof = proof_of(tree, place[r[2]], fan) + proof_of(top, langs.index(r[2]), fan)
        place[r[2]] += 1
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
        other = whole([*leaves[:i], leaf(*r[:4], r[4] + 1) if changed else leaves[i], *leaves[i + 1:]])[1]
        out.append((r[0], leaves[i], tree[-1][0], top[-1][0], sha("".join(proof)), other[-1][0], other[-1][0] == top[-1][0]))
    return sorted(out, key=repr)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_merkle_query(spark, rows, tmp_path):
    for name, some in (("whole", rows), ("one", rows[:1]), ("none", [])):
        spark.createDataFrame(some, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = bag(queries.op13_merkle_manifest(spark, f"{tmp_path}/{name}"), *MANIFEST)
        assert got == plain_manifest(some)
    assert sum(not x[-1] for x in plain_manifest(rows)) > 5


@pytest.mark.parametrize(("fan", "block_levels"), [(2, 1), (2, 3), (3, 2)])
def test_merkle_tiers(docs, rows, fan, block_levels):
    """Small blocks: many tiers, with last runs of every length."""
    from pyspark.sql import functions as F

    grown = F.col("n_chars").cast("decimal(38,0)") + 1
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, grown).otherwise(F.col("n_chars"))
    told = merkle.manifest(docs, TABLE, "doc_id", "lang", {"n_chars": tampered}, fan, block_levels)
    assert bag(told.withColumn("proof_sha256", F.sha2("proof", 256)), *MANIFEST) == plain_manifest(rows, fan)


def test_merkle_without_changes(docs, rows):
    told = merkle.manifest(docs, ["doc_id", "text"], "doc_id", "lang").collect()
    assert len(told) == len(rows) and all(r.verified for r in told)
