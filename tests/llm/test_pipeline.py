"""The pipeline's stages, each on what the one before kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orelode.llm.cluster import stored


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    from tests.llm.test_operators import BASE, ITEMS, PASSAGE, near, prose

    d = tmp_path_factory.mktemp("sf")
    texts = [prose(120) for _ in range(40)] + [BASE, near(BASE, 1), near(BASE, 2), None, "", "?! 123", prose(50) + " " + PASSAGE + " " + prose(50), PASSAGE + " " + prose(60), prose(60) + " " + ITEMS[0][1] + " " + prose(60), ITEMS[1][1]]
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([i for i in ITEMS if i[0] in (0, 1)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, sf_dir):
    from tests.llm.test_operators import ITEMS, PASSAGE

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert {43, 44, 45}.isdisjoint(kept["identify_language"]) and len(kept["identify_language"]) >= 44
    assert 40 in kept["join_near_duplicates"] and {41, 42}.isdisjoint(kept["join_near_duplicates"])
    assert all(PASSAGE not in t for t in kept["cut_repeats"].values())
    assert ITEMS[0][1] not in kept["cut_benchmark"].get(48, "") and 49 not in kept["cut_benchmark"]
    assert set(range(40)) <= set(kept["cut_benchmark"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.where("not round_trip").count() == 0 and last.where(F.size("ids") != F.col("n_pieces")).count() == 0


def test_run_on_nothing(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_against_plain_versions(spark, sf_dir):
    """Each stage on the rows that the one before kept, against a version in plain Python."""
    import re

    import sentencepiece

    from orelode.llm.cluster import tokenizer_file
    from tests.llm.test_operators import ITEMS, WORD, brute_components, low

    stages = dict(corpus_pipeline.STAGES)
    docs = stored(stages["identify_language"](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    # of each component of 5-word shingles at 0.8 the smallest id
    docs = stored(stages["join_near_duplicates"](spark, docs, sf_dir))
    roots = {key: root for key, _, root in brute_components(rows, 5, 80, 100)}
    rows = [(k, t) for k, t in rows if roots[k] == k]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == rows
    # words of windows of 35 that start anywhere else too go, with the white space after them
    docs = stored(stages["cut_repeats"](spark, docs, sf_dir))
    words = {k: WORD.findall(t) for k, t in rows}
    seen = {}
    for k, w in words.items():
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i : i + 35]), []).append((k, i))
    gone = {k: set() for k in words}
    for places in seen.values():
        for k, i in places if len(places) > 1 else ():
            gone[k].update(range(i, i + 35))
    kept = []
    for k, t in rows:
        spans = [m.span() for m in WORD.finditer(t)]
        if gone[k] and len(gone[k]) == len(spans):
            continue
        starts = [a for a, _ in spans] + [len(t)]
        kept.append((k, t[: starts[0]] + "".join(t[starts[i] : starts[i + 1]] for i in range(len(spans)) if i not in gone[k]) if gone[k] else t))
    rows = kept
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == rows and any(gone.values())
    # spans of benchmark windows go; documents that are mostly such spans too
    docs = stored(stages["cut_benchmark"](spark, docs, sf_dir))
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for key, t in ITEMS:
        w = alnum.findall(low(t or "")) if key in (0, 1) else []
        k = min(10, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1 if w else 0)}
    kept = []
    for k, t in rows:
        found = list(alnum.finditer(low(t)))
        w = [m[0] for m in found]
        hit = {j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if 2 * len(hit) > len(w):
            continue
        out, at = "", 0
        for i in sorted(hit):
            out += t[at : found[i].start()] if i - 1 not in hit else ""
            at = found[i].end()
        kept.append((k, out + t[at:]))
    rows = kept
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == rows
    # ids of the library
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert sorted((r.doc_id, list(r.ids)) for r in stages["encode_pieces"](spark, docs, sf_dir).collect()) == [(k, lib.encode(t)) for k, t in rows]
