import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from answerscope.llm import bpe, toxicity
from answerscope.llm.common import prepare, save, table
from test_jaccard import plain as plain_components
from test_mixing import COUNT, plain_targets

FOLDER = "/root/testdata/sf0.01"  # enough labels for the classifier to find words
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """Rows of documents and of what each stage returns."""
    docs = table(prepare(spark), FOLDER, "documents")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, FOLDER), "test")
        out.append(docs.collect())
    return out


def key(rows):
    return sorted(tuple(r[c] for c in COLUMNS) for r in rows)


def test_stages_keep_the_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(list(rows[0].asDict()) == COLUMNS for rows in steps[:5])


def test_toxicity_stage(spark, steps):
    labels = {r.doc_id: r.toxic for r in table(spark, FOLDER, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    sample = sorted((r.doc_id, r.text or "", labels[r.doc_id]) for r in steps[0] if r.doc_id in labels)
    scorer = toxicity.Scorer(toxicity.fit([t for _, t, _ in sample], [y for *_, y in sample]))
    want = [r for r in steps[0] if scorer.sentences(r.text or "")[0] < toxicity.THRESHOLD]
    assert key(steps[1]) == key(want) and len(steps[1]) < len(steps[0])


def test_exact_stage(steps):
    first = {}
    for r in sorted(steps[1], key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert key(steps[2]) == key(first.values()) and len(steps[2]) < len(steps[1])


def test_jaccard_stage(steps):
    kept = {d for d, _, component in plain_components([(r.doc_id, r.text) for r in steps[2]]) if d == component}
    assert key(steps[3]) == key([r for r in steps[2] if r.doc_id in kept])


def test_mixing_stage(steps):
    words = lambda rows, source: sum(len(COUNT.findall(r.text)) for r in rows if r.source == source)
    sources = {r.source for r in steps[3]}
    wanted = plain_targets({s: words(steps[3], s) for s in sources})
    before = {r.doc_id: r for r in steps[3]}
    assert all(abs(words(steps[4], s) - wanted[s]) <= 1 for s in sources)
    for r in steps[4]:
        own = set(COUNT.findall(before[r.doc_id].text))
        assert set(COUNT.findall(r.text)) <= own and r.n_chars == len(r.text) and r.source == before[r.doc_id].source


def test_encoding_stage_and_run(spark, steps):
    path, pattern = bpe.vocabulary()
    oracle = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = {r.doc_id: oracle.encode_ordinary(r.text) for r in steps[4]}
    assert {r.doc_id: list(r.token_ids) for r in steps[5]} == want
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert whole == {d: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() for d, ids in want.items()}


def test_hard_rows_pass_all_stages(session, edge, tmp_path):
    edge.select(*COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    session.createDataFrame([(1, 1, None), (None, 0, 1), (9, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(session, str(tmp_path)).collect()
    assert got and all(r.n_tokens == len(r.token_ids) for r in got)
    empty = tmp_path / "none"
    edge.select(*COLUMNS).limit(0).write.parquet(str(empty / "documents.parquet"))
    session.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(session, str(empty)).count() == 0


def test_encoding_stage_leaves_no_tables_in_python_workers(spark):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(16)], "doc_id long, text string").repartition(8)
    assert len(corpus_pipeline.encoded(spark, docs, FOLDER).collect()) == 16
    tables = corpus_pipeline.ENCODER_TABLES

    def kept(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(key[2] == tables for key in bpe._LOADED)])], names=["n"])

    assert {r.n for r in docs.mapInArrow(kept, "n long").collect()} == {0}
