"""The pipeline's stages, each against what it must do."""

import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from claimweave.llm import mixing, near_copies, piece_codec, queries, toxicity
from tests.llm.test_near_copies import brute_links, keepers

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_every_stage_takes_effect(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substring", "mixing", "sentencepiece"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, FOLDER)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        if name == "simhash":
            keepers = {r["keep_id"] for r in near_copies.near_copies(at).collect()}
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == keepers
        if name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.with_copies(at).collect()}
            assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: n for k, n in copies.items() if n})
        if name == "substring":
            assert out.count() == at.count()
        at = out
    last = corpus_pipeline.STAGES[-1][1](spark, at, FOLDER)
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and last.count() == at.count()


def test_toxic_documents_go(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, FOLDER)
    scores = toxicity.with_scores(docs, toxicity.fit(docs, labels))
    assert left.count() == scores.where(F.col("score") < toxicity.THRESHOLD).count() == docs.count() - scores.where(F.col("score") >= toxicity.THRESHOLD).count()


def test_stages_take_odd_rows(spark, docs):
    odd = docs.limit(5).union(docs.limit(3)).union(spark.createDataFrame([(None, None, None, None, None), (7, "", None, None, None)], docs.schema)).withColumn("spans", F.lit("x"))
    for at in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, FOLDER)
        assert at.count() >= 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = con.sql(queries.oracle_sql()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(row[names.index(c)] for c in columns) for row in relation.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == theirs


def brute_kept_words(texts, w=35):
    """The texts without the words of windows that start anywhere else, too; untouched texts as they are."""
    cut = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(x[i : i + w]) for x in cut for i in range(len(x) - w + 1))
    for t, x in zip(texts, cut):
        gone = {j for i in range(len(x) - w + 1) if seen[tuple(x[i : i + w])] > 1 for j in range(i, i + w)}
        yield b" ".join(y for i, y in enumerate(x) if i not in gone).decode() if gone else t


def brute_copies(rows):
    """How often each (doc_id, text, source) is taken: targets by bisection, then the whole part and one draw."""
    size = {r: len((r[1] or "").encode().split()) for r in rows}
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[r] for r in rows if r[2] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    low, high, whole = 0.0, 3.0 * sum(own.values()), sum(own.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * own[s], level * weight[s]) for s in sources) < whole else (low, level)
    rate = {s: min(3 * own[s], high * weight[s]) / own[s] if own[s] else 0.0 for s in sources}
    for r in rows:
        seeded = f"{mixing.SEED}|{'' if r[0] is None else r[0]}|{r[1] or ''}"
        draw = int(hashlib.md5(seeded.encode()).hexdigest()[:13], 16) / 2**52
        yield int(rate[r[2]]) + (draw < rate[r[2]] - int(rate[r[2]]))


def test_run_equals_brute_force_from_end_to_end(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    model = toxicity.fit(docs, labels)
    rows = [r for r, s in zip(rows, model.scores([r[1] for r in rows])) if s < toxicity.THRESHOLD]
    links = [(i, j) for i, j, apart in brute_links([r[:2] for r in rows]) if apart < 99]
    kept = set(keepers([r[:2] for r in rows], links))
    rows = [r for r in rows if r[0] in kept]
    rows = [(r[0], t, r[2]) for r, t in zip(rows, brute_kept_words([r[1] for r in rows]))]
    piece = piece_codec.PieceModel.of(public_tokenizers.path("piece_bpe_32k.model")).processor
    expected = Counter()
    for r, n in zip(rows, brute_copies(rows)):
        expected[r[0], tuple(piece.encode(r[1] or ""))] += n
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == +expected
