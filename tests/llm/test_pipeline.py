import corpus_pipeline
from pyspark.sql import functions as F

from quarryline.llm.pieces import model_of
from tests.llm.test_near_texts import jaccard, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_one_another(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").cache()
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, seen[-1], d), f"test-{name}").cache()
        assert out.columns[: len(COLUMNS)] == COLUMNS
        seen.append(out)
    start, clean, single, cut, mixed, coded = ([r.asDict() for r in x.collect()] for x in seen)
    assert len(start) > len(clean) > len(single) >= len({r["doc_id"] for r in cut})
    # Near copies: brute force over sets of word shingles, one document of each group, the least.
    sets = {r["doc_id"]: shingles(r["text"]) for r in clean}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and jaccard(sets[a], sets[b]) >= corpus_pipeline.SIMILARITY:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r["doc_id"] for r in single) == sorted({find(i) for i in sets})
    # Repeats: no 400 bytes that stood twice are left, and texts are no longer than before.
    times = {}
    for r in single:
        t = r["text"].encode()
        for q in range(len(t) - 399):
            times[t[q : q + 400]] = times.get(t[q : q + 400], 0) + 1
    before = {r["doc_id"]: r["text"] for r in single}
    for r in cut:
        t = before[r["doc_id"]].encode()
        gone = [False] * len(t)
        for q in range(len(t) - 399):
            if times[t[q : q + 400]] > 1:
                gone[q : q + 400] = [True] * 400
        assert r["text"].encode() == bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore").encode()
        assert r["n_chars"] == len(r["text"])
    # The mix: words near the targets of the sources of what is left.
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(words(mixed) - words(cut)) < 0.25 * words(cut) and {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in cut}
    m = model_of(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY))
    assert len(coded) == len(mixed) and all(r["round_trip"] and len(r["piece_ids"]) == 4 * r["n_pieces"] for r in coded)
    assert all(m.encode([r["text"]])[0].astype("<u4").tobytes() == bytes(r["piece_ids"]) for r in coded[:50])


def test_null_rows_and_clashing_names_go_through(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    given = [(1, None, None, None, None), (None, "some words here", "en", None, 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "some other words stand here", "fr", None, 27), (3, "some other words stand here", "en", None, 27)]
    rows = docs.unionByName(spark.createDataFrame(given, docs.schema)).withColumns({"_key": F.lit("k"), "_toxicity": F.lit(7.0), "_position": F.col("lang"), "n_removed_": F.lit(1), "s1": F.lit(2)})
    columns, kept = rows.columns, []
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.materialize(stage(spark, rows, "/root/testdata/sf0.001"), "nulls")
        assert rows.columns[: len(columns)] == columns and (name == "pieces" or rows.columns == columns), name
        assert rows.where("_key <> 'k' or _toxicity <> 7 or not (_position <=> lang) or n_removed_ <> 1 or s1 <> 2").isEmpty(), name
        kept.append(sorted((str(r["doc_id"]), r["text"]) for r in rows.collect()))
    # Nothing is toxic; null and empty texts are copies, as are those of document 3. One source, so the mix takes its words once; texts without words may go along.
    assert len(kept[0]) == 6 and kept[1] == kept[2] == [("1", None), ("3", "some other words stand here"), ("None", "some words here")]
    assert set(kept[3]) <= set(kept[2]) and sum(len((t or "").split()) for _, t in kept[3]) <= 2 * 8 and kept[4] == kept[3] and kept[3]


def test_repeated_passages_of_over_50_words_go(spark):
    passage = " ".join(f"w{i}" for i in range(51))
    assert len(passage) < 400
    rows = [(1, f"one {passage} ends", "en", "s", 0), (2, f"another {passage} stops", "en", "s", 0), (3, f"third {passage[:-1]}", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_array(spark, docs, "").collect()}
    assert got == {1: "one  ends", 2: "another  stops", 3: rows[2][1]}
