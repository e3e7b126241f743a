import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import schemas
from corvane.config import EngineConfig
from corvane.functions.vectors import cosine, search
from corvane.operators import evaluation, merging, reranking, retrieval
from corvane.operators.analysis import analyze

CFG = EngineConfig()


def test_search_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    q = rng.normal(size=(7, 16))
    rows = spark.createDataFrame([(f"c{i:04d}", v.tolist(), "x") for i, v in enumerate(x)] + [("c0000", x[0].tolist(), "x"), ("n", None, ""), ("z", [0.0] * 16, ""), ("b", [float("nan")] * 16, ""), ("s", [1.0], "")], "chunk_id string, embedding array<double>, id string")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None), (98, [0.0] * 16)], "query_id int, vector array<double>")
    s = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    want = {(i, f"c{j:04d}") for i in range(7) for j in np.argsort(-s[i])[:20] if s[i, j] > 0.3}
    got = search(rows.repartition(5), queries, 20, 0.3).collect()
    assert {(r.query_id, r.id) for r in got} == want and len(got) == len(want)
    assert search(rows, queries.limit(0), 5, 0.3).count() == 0 and search(rows.limit(0), queries, 5, 0.3).count() == 0
    with pytest.raises(ValueError):
        search(rows, queries, 5, 0.3, most_queries=3)


def test_cosine_expression(spark):
    r = spark.sql("select array(1.0d, 0.0d) a, array(1.0d, 1.0d) b, array(0.0d, 0.0d) z").select(cosine(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("z"))).first()
    assert r[0] == pytest.approx(0.5**0.5) and r[1] is None


def walk(rows, budget):
    used, kept = 0, []
    for i, t in rows:
        if not kept or used + t <= budget:
            kept.append(i)
            used += t
    return kept


@pytest.mark.parametrize("budget", [100, 10, 1000])
def test_first_fit(spark, budget):
    rng = random.Random(budget)
    rows = [(q, f"p{i:02d}", round(1 - i / 100, 4), rng.choice([50, 80, 40, 5])) for q in range(4) for i in range(25)]
    df = spark.createDataFrame([(q, p, s, s, t) for q, p, s, t in rows], "query_id int, parent_id string, score double, raw_similarity double, tokens int")
    got = retrieval.within_budget(df, budget).collect()
    for q in range(4):
        assert [r.parent_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == walk([(p, t) for k, p, _, t in rows if k == q], budget)


def chunk_rows(n=6, doc="d", **more):
    base = dict.fromkeys(schemas.CHUNKS.names)
    return [tuple((base | {"chunk_id": f"{doc}{i}", "document_id": doc, "chunk_level": "parent", "chunk_index": i, "chunk_text": f"text {i}", "token_start": i * 25, "token_end": i * 25 + 25, "char_start": i * 100, "char_end": i * 100 + 6, "source_url": f"https://{doc}.example", "depth": 0, **{f: False for f in schemas.FLAGS}} | more).values()) for i in range(n)]


def test_full_context_and_empty_corpus(spark):
    df = spark.createDataFrame(chunk_rows(6, "a") + chunk_rows(6, "b") + chunk_rows(1, "a"), schemas.CHUNKS)
    got = retrieval.full_context(df, CFG, 120).orderBy("position").collect()
    assert [r.chunk_id for r in got] == ["a0", "a1", "a2", "a3"] and got[0].score == 1.0 and got[0].raw_similarity is None
    assert [r.chunk_id for r in retrieval.full_context(df, CFG, 1).collect()] == ["a0"]
    assert retrieval.full_context(df.limit(0), CFG).count() == 0
    one = spark.createDataFrame([("b", "https://b.example")], "x string, source_url string")
    assert {r.document_id for r in retrieval.full_context(df, CFG, 1000, one).collect()} == {"b"}
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    assert retrieval.retrieve_chunks(df.limit(0), q).count() == 0
    n = retrieval.corpus_counts(df, df.select("document_id").distinct()).first()
    assert tuple(n) == (2, 12, 300)


def test_citation(spark):
    df = spark.createDataFrame([("hello world", 10, 21)], "chunk_text string, char_start int, char_end int")
    cite = lambda a, b: df.select(retrieval.citation(F.lit(a), F.lit(b))).first()[0]
    assert cite(10, 15) == "hello" and cite(16, 21) == "world" and cite(9, 12) is None and cite(12, 22) is None and cite(12, 12) is None


@pytest.mark.parametrize(
    "query, subs, kind",
    [
        ("gradient boosting vs random forests", ["gradient boosting", "random forests"], "comparison"),
        ("pros and cons of microservices", ["advantages of microservices", "disadvantages of microservices"], "comparison"),
        ("what is backpropagation", ["what is backpropagation"], "factual"),
        ("how does gradient descent work and when should I use it", ["how does gradient descent work", "when should I use it"], "how_to"),
        ("What is the difference between A and B", ["What is the", "A and B"], "comparison"),
        ("lists and tuples in python", ["lists for python", "tuples for python"], "exploratory"),
        ("", [""], "exploratory"),
    ],
)
def test_analysis(spark, query, subs, kind):
    df = spark.createDataFrame([(query, "clash"), (None, "")], "query string, query_type string")
    r = analyze(df).collect()
    assert len(r) == 1 and r[0].sub_queries == subs and r[0].query_type == kind and r[0].complexity == ("simple" if len(subs) == 1 else "moderate")


def test_key_concepts(spark):
    df = spark.createDataFrame([("gradient boosting vs random forests",), ("The scikit-learn and the v2.0 of x in one two three four five six",)], "query string")
    got = [r.key_concepts for r in analyze(df, constraints=["now"]).collect()]
    assert got[0] == ["gradient", "boosting", "random", "forests"] and got[1] == ["scikit-learn", "v2.0", "one", "two", "three", "four"]
    assert analyze(df, intent=F.lit("factual"), constraints=["a", "b"]).first().sub_queries == ["gradient boosting a b", "random forests a b"]


def scored(spark, scores, tokens=25, sources=None):
    rows = [(1, f"c{i:02d}", float(s), tokens, (sources or ["u"])[i % len(sources or ["u"])]) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "query_id int, chunk_id string, score double, tokens int, source_url string")


@pytest.mark.parametrize(
    "scores, cfg, how, action, rule",
    [
        ([0.78, 0.76, 0.75, 0.74, 0.73, 0.72, 0.71, 0.70, 0.69, 0.68], {"mediocre_floor": 0.5, "reranker": "x"}, {}, "stop", 3),
        ([0.8, 0.75, 0.72, 0.70, 0.68], {}, {"budget": 100}, "stop", 1),
        ([0.75, 0.73, 0.72, 0.70, 0.69, 0.68, 0.67, 0.66], {"plateau_variance": 0.0001}, {"iteration": 1, "previous": 8}, "stop", 2),
        ([0.82, 0.45, 0.42, 0.40, 0.38, 0.36, 0.34, 0.32, 0.30, 0.28], {}, {}, "expand_breadth", 6),
        ([0.82] + [0.45 + 0.0003 * i for i in range(9)], {"redundancy_ceiling": 0.3, "plateau_variance": 0.0001}, {}, "expand_intent", 5),
        ([0.38, 0.36, 0.34, 0.32, 0.30], {"mediocre_floor": 0.5, "reranker": "x"}, {"sources": ["a", "b"]}, "expand_intent", 7),
        ([0.38, 0.36, 0.34], {"mediocre_floor": 0.5, "reranker": "x"}, {}, "expand_breadth", 7),
        ([0.30, 0.29], {"max_expansion_depth": 3}, {"iteration": 3}, "stop", 4),
        ([0.9, 0.1], {"cliff_threshold": 2.0}, {}, "expand_breadth", 9),
    ],
)
def test_decisions(spark, scores, cfg, how, action, rule):
    c = CFG.with_(**cfg)
    s = evaluation.signals(scored(spark, scores, 30 if "budget" in how else 25, how.get("sources")), c, how.get("budget", 4096))
    d = evaluation.decide(s, c, how.get("iteration", 0), F.lit(how["previous"]) if "previous" in how else None).first()
    assert (d.action, d.rule) == (action, rule) and d.reason


def test_signals_of_nothing(spark):
    none = evaluation.empty_signals()
    df = spark.createDataFrame([tuple(float(v) if type(v) is int else v for v in none.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double'}" for k, v in none.items()))
    d = evaluation.decide(df.withColumn("chunks_above_threshold", F.lit(0)).withColumn("source_document_count", F.lit(0))).first()
    assert (d.action, d.rule) == ("expand_breadth", 8)
    assert evaluation.signals(scored(spark, [])).count() == 0


def test_reranking(spark):
    rows = scored(spark, [0.65, 0.52, 0.41, 0.38]).withColumn("position", F.row_number().over(retrieval.Window.orderBy("chunk_id"))).withColumn("raw_similarity", F.col("score"))
    got = reranking.pass_through(rows, 3).orderBy("reranked_rank").collect()
    assert [r.chunk_id for r in got] == ["c00", "c01", "c02"] and got[0].confidence is None
    assert reranking.passing(rows, 0.4).count() == 3 and [r.chunk_id for r in reranking.passing(rows, 0.9).collect()] == ["c00"]
    full = rows.withColumn("query", F.lit("beta")).withColumn("selected_text", F.when(F.col("chunk_id") == "c03", "<b>beta</b>").otherwise("x")).withColumn("image_context_text", F.lit(None).cast("string"))

    class Words:
        def rerank(self, query, passages):
            return [(i, float(query in p), 0.5) for i, p in enumerate(passages)]

    class Broken:
        def rerank(self, query, passages):
            raise OSError("down")

    assert reranking.rerank(full, Words()).orderBy("reranked_rank").first().chunk_id == "c03"
    assert [r.chunk_id for r in reranking.rerank(full, Broken()).orderBy("reranked_rank").collect()] == ["c00", "c01", "c02", "c03"]


def mmr(rows, ceiling):
    kept = []
    for i, t in rows:
        w = set((t or "").lower().split())
        if not any(w and k and len(w & k) / len(w | k) > ceiling for _, k in kept):
            kept.append((i, w))
    return [i for i, _ in kept]


def test_near_duplicates_by_arrival(spark):
    rng = random.Random(4)
    rows = [(g, n, f"c{n:02d}", " ".join(rng.choice("abcdefgh") for _ in range(6)) if n % 7 else None) for g in range(3) for n in range(30)]
    df = spark.createDataFrame(rows, "query_id int, ord int, chunk_id string, selected_text string")
    got = merging.without_near_duplicates(df, 0.5).collect()
    for g in range(3):
        assert sorted(r.chunk_id for r in got if r.query_id == g) == mmr([(c, t) for k, _, c, t in rows if k == g], 0.5)
    assert merging.without_near_duplicates(df, 1.0).count() == len(rows) and merging.without_near_duplicates(df.limit(0), 0.5).count() == 0


def test_union_and_prefix_budget(spark):
    df = spark.createDataFrame([(1, 1, "a", 0.72, 50), (1, 2, "b", 0.9, 60), (1, 3, "a", 0.85, 50), (1, 4, "c", 0.1, 1)], "query_id int, ord int, chunk_id string, score double, tokens int")
    u = {r.chunk_id: (r.ord, r.score) for r in merging.union_by_chunk(df).collect()}
    assert u == {"a": (1, 0.85), "b": (2, 0.9), "c": (4, 0.1)}
    kept = lambda n: [r.chunk_id for r in merging.prefix_budget(merging.union_by_chunk(df), n).orderBy("rank").collect()]
    assert kept(100) == ["b"] and kept(110) == ["b", "a"] and kept(10) == ["b"] and kept(0) == ["b", "a", "c"]


def test_neighbours(spark):
    c = spark.createDataFrame(chunk_rows(5, "d"), schemas.CHUNKS)
    hits = lambda *i: spark.createDataFrame([(1, f"d{k}", "d", k, s) for k, s in i], "query_id int, chunk_id string, document_id string, chunk_index int, score double")
    got = merging.neighbours(hits((2, 0.9)), c).collect()
    assert sorted(r.chunk_index for r in got) == [1, 3] and all(r.score == 0 and r.is_locality_expanded for r in got)
    assert [r.chunk_index for r in merging.neighbours(hits((0, 0.9)), c).collect()] == [1] and merging.neighbours(hits((2, 0.2)), c).count() == 0
    assert sorted(r.chunk_index for r in merging.neighbours(hits((1, 0.9), (2, 0.9)), c).collect()) == [0, 3]
