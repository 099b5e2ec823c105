"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re

import pytest

from orrery.llm import langid, line_dedup, media, neardup, packing, quality, sharding, simhash, token_counts
from orrery.llm import bpe
from orrery.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 97} and{i}" for i in range(30_000))
A = " ".join(f"w{i}" for i in range(200))
ROWS = [(1, None, 1), (2, "", 2), (3, "Hello there\nGeneral Kenobi", 3), (4, A, 4), (5, A, 5), (6, A + " x", 6), (7, LONG, 7), (8, " \n\t ", 8), (9, "one two", 9), (9, "one two", 9), (10, "你好 \U0001f600", 10)]
SCHEMA = "doc_id long, text string, n int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_and_counts(docs, none):
    path = tokenizer_path()
    ids = by_id(bpe.encode(docs, path))
    assert ids[1]["ids"] == ids[2]["ids"] == []
    back = by_id(bpe.decode(bpe.encode(docs, path), path))
    counts = by_id(token_counts.token_counts(docs, path))
    trips = by_id(bpe.round_trip(docs, path))
    for key, text, _ in ROWS:
        assert back[key]["text"] == (text or "")
        assert counts[key]["n_tokens"] == len(ids[key]["ids"]) == trips[key]["n_tokens"]
        assert trips[key]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode(none, path).count() == token_counts.token_counts(none, path).count() == packing.pack(none, path).count() == 0


def test_packing(docs):
    rows = packing.pack(docs, tokenizer_path()).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_media(docs, none):
    out = by_id(media.features(media.write_media(docs)))
    for key, text, _ in ROWS:
        raw = media.padded((text or "").encode())
        assert out[key]["payload_sha256"] == hashlib.sha256(raw).hexdigest()
    assert media.packets(media.write_media(docs)).count() > 11 and media.features(media.write_media(none)).count() == 0


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, docs, none):
    out = sharding.shard(docs).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert r["shard"] == jump(r["doc_id"], 16) and r["grown_shard"] == jump(r["doc_id"], 17)
    keys = spark.createDataFrame([(k,) for k in (-1, -(2**63), 2**63 - 1, 123456789012345)], "doc_id long")
    assert [r[0] for r in keys.select(sharding.jump_hash(keys.doc_id, 1000)).collect()] == [jump(r[0], 1000) for r in keys.collect()]
    assert sharding.shard(none).count() == 0


def test_simhash(spark, docs, none):
    out = simhash.near_edits(docs).collect()
    assert len(out) == len(ROWS)
    got = {r["doc_id"]: r for r in out}
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[4]["near_next"] == 1.0
    n = len(A)
    assert got[4]["edited_sha256"] == hashlib.sha256((A[: n - n // 4] + A[: n // 4]).encode()).hexdigest()
    assert simhash.near_edits(none).count() == 0
    import random

    r = random.Random(0)
    base = [r.getrandbits(64) for _ in range(60)]
    near = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 5))) for b in base]
    signed = [x - (1 << 64) if x >> 63 else x for x in near]
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {(a, b) for a, b, _ in simhash.within_radius(prints, prints).collect()}
    dist = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    assert found == {(a, b) for a in signed for b in signed if dist(a, b) <= 3}


def test_line_dedup(spark, none):
    para = "\n".join(f"line {i} of the shared passage" for i in range(12))
    long = " ".join(f"passage{i}" for i in range(60))
    rows = [(1, "own a\n" + para + "\nown b", "x"), (2, "other\n" + para + "\nlast", "y"), (3, None, "z"), (4, "", "z"), (5, "head\n" + long, "q"), (6, long + "\ntail", "q"), (7, "solo", "q"), (8, "solo", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string")
    out = by_id(line_dedup.dedup(df))
    assert out[1]["text"] == rows[0][1] and out[1]["place"] == "x"
    assert len(out[2]["text"]) < len(rows[1][1]) / 2 and out[2]["text"].startswith("other") and out[2]["text"].endswith("last")
    assert out[3]["text"] is None and out[4]["text"] == "" and out[5]["text"] == rows[4][1]
    assert out[6]["text"] == "tail" and out[7]["text"] == out[8]["text"] == "solo"
    assert line_dedup.dedup(none).count() == 0
    # nothing is lost: every text is made of the chunks kept somewhere
    chunks = {r["body"] for r in line_dedup.kept_chunks(df).collect()}
    assert {r["body"] for r in line_dedup.chunk_rows(df, "doc_id", "text").collect()} == chunks


def test_chunks_are_compared_by_bytes(spark, monkeypatch):
    """Chunks whose hashes all collide are removed only where their bytes are equal."""
    rows = [(k, "\n".join([f"own {k}"] + [f"line {i} of passage {k % 3}" for i in range(9)])) for k in range(6)]
    rows += [(10, "two\nlines"), (11, "two\nlines\nmore"), (12, None), (13, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: r["text"] for i, r in by_id(line_dedup.dedup(df)).items()}
    assert [want[k] == t for k, t in rows[:3]] == [True] * 3 and all(want[k] != t for k, t in rows[3:6])
    plain = line_dedup._meeting
    from pyspark.sql import functions as F

    monkeypatch.setattr(line_dedup, "_meeting", lambda kind, marks: (F.lit(7).cast("long"),) * 2 if kind else plain(kind, marks))
    assert {i: r["text"] for i, r in by_id(line_dedup.dedup(df)).items()} == want


def test_near_duplicates(spark, docs, none):
    out = by_id(neardup.near_duplicates(docs))
    assert out[5]["component_id"] == out[6]["component_id"] == 4 and out[4]["kept"] and not out[6]["kept"]
    assert out[1]["n_shingles"] == out[8]["n_shingles"] == 0 and out[9]["n_shingles"] == 1
    assert neardup.near_duplicates(none).count() == 0
    # a long list with many components, against brute force
    import random

    r = random.Random(5)
    base = [f"t{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for k in range(40):
        words = list(base)
        for i in r.sample(range(150), r.choice([0, 1, 2, 3, 4, 6, 9])):
            words[i] = f"e{r.randrange(10**6)}"
        rows.append((k, " ".join(words), 0))
    got = by_id(neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (re.findall(r"\S+", t) for _, t, _ in rows)]
    root = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(i):
                c = len(sets[i] & sets[j])
                if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                    root[i] = root[j] = min(root[i], root[j])
    assert [got[k]["component_id"] for k in range(40)] == root


def test_classifiers(spark, docs, none):
    from pyspark.sql import functions as F

    labelled = spark.createDataFrame([(i, f"good words here {i}" if i % 3 else f"BAD!! BAD!! {i}", "en") for i in range(90)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    model = quality.fit(labelled, labels, F.lit(True))
    scores = by_id(quality.score(labelled, model))
    assert all((scores[i]["score"] >= 0.5) == (i % 3 > 0) for i in range(90))
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())
    net = langid.fit(labelled, F.lit(True))
    got = by_id(langid.predict(docs, net))
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[8]["lang_pred"] == "und" and got[4]["lang_pred"] == "en"
    assert quality.score(none, model).count() == langid.predict(none, net).count() == 0


def repeated_lines(texts, least=50):
    """By brute force: per document the lines in runs of `least` words or more that occur earlier, from a line with words to one."""
    lines = [t.split("\n") for t in texts]
    seen, gone = {}, [set() for _ in texts]
    for d, own in enumerate(lines):
        for i in range(len(own)):
            for j in range(i, len(own)):
                run = tuple(own[i : j + 1])
                if own[i].split() and own[j].split() and sum(len(x.split()) for x in run) >= least and seen.setdefault(run, (d, i)) < (d, i):
                    gone[d].update(range(i, j + 1))
    return gone


def test_line_dedup_short_passages_at_every_offset(spark):
    import random

    r = random.Random(3)
    words = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    passages = [[words(30), words(30)], [words(24), words(26)], [words(40), words(45), words(1)], [words(20), "", words(20), words(12)], [words(12) for _ in range(5)], [words(60)], [words(1) for _ in range(55)]]
    texts = []
    for p in passages:
        for before in range(5):
            texts.append("\n".join([words(r.choice([0, 3, 9])) for _ in range(before)] + p + [words(4) for _ in range(before % 3)]))
    texts += ["\n".join([words(5), *passages[0], words(3), *passages[0]]), "\n".join(["one two three four five six seven eight nine ten"] * 12), "\n\n \n", "x"]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    # modulus is too large for a cut within a document: runs alone decide
    out = by_id(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, place string").repartition(3), modulus=2**40))
    for (key, text, _), gone in zip(rows, repeated_lines(texts), strict=True):
        assert out[key]["text"] == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), key
    # with cuts inside too no line of a repeated passage stays
    out = by_id(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, place string")))
    for (key, text, _), gone in zip(rows, repeated_lines(texts), strict=True):
        lines, kept = text.split("\n"), out[key]["text"].split("\n")
        long = {lines[i] for i in gone if lines[i]} - {x for i, x in enumerate(lines) if i not in gone}
        assert not long & set(kept), key


def test_simhash_one_word_many_times(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "wordy " * 50_000), (2, "wordy wordy")], "doc_id long, text string")
    expected = df.select(F.xxhash64(F.lit("wordy wordy"))).first()[0]
    assert {r["doc_id"]: r["fp"] for r in simhash.fingerprints(df, ["doc_id"]).collect()} == {1: expected, 2: expected}


def test_pipeline_near_stage_threshold(spark):
    import corpus_pipeline

    base = [f"t{i}" for i in range(150)]
    edited = lambda *at: " ".join(f"e{i}" if i in at else w for i, w in enumerate(base))
    # of 146 shingles 5 differ for each edit: likeness 131 / 161 = 0.81 and 126 / 166 = 0.76
    rows = [(1, edited(), 0), (2, edited(20, 60, 100), 0), (11, edited().replace("t", "u"), 0), (12, edited(20, 60, 100, 130).replace("t", "u"), 0)]
    out = corpus_pipeline.near(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 11, 12]


def test_components_are_the_same_on_the_driver_and_in_tables(spark):
    rng = random.Random(8)
    edges = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(200)} | {(k, k + 1) for k in range(1000, 1040)}
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    roots = {x: x for e in edges for x in e}
    for _ in roots:
        for a, b in edges:
            roots[a] = roots[b] = min(roots[a], roots[b])
    for few in (len(edges), len(edges) - 1):
        assert {tuple(r) for r in neardup.components(df, few).collect()} == set(roots.items())
    assert neardup.components(df.where("a < 0")).count() == 0
