"""The queries of the training-data problems and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.urls import LANGUAGE_NAMES
from corvane.llm import markup, mixing, near_duplicates, packing, residue, same_look, similar_vectors, site_lines, splitting, token_budget, tokens
from corvane.session import cut_lineage, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return similar_vectors.found(table(spark, root, "chunks"))


def p1_nearest(spark: SparkSession, root: str) -> DataFrame:
    return similar_vectors.nearest(table(spark, root, "chunks").where("chunk_level = 'child'"), floor=None)


def p1_recall(spark: SparkSession, root: str) -> DataFrame:
    """Whether the hashed search gives at least 0.9 of the true five nearest of a stated set of rows, compared with every vector."""
    r = similar_vectors.recall(table(spark, root, "chunks").where("chunk_level = 'child'"))
    return r.select("asked", "wanted", (F.col("recall") >= 0.9).alias("enough"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.found(table(spark, root, "chunks"))


def p2_groups(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates.groups(table(spark, root, "chunks").where("chunk_level = 'child'"))


def p3_invariants(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the pieces of every item that is cut."""
    items = splitting.corpus_items(*(table(spark, root, t) for t in ("normalized_documents", "chunks", "split_limits"))).dropDuplicates(["item_kind", "item_key"])
    p = splitting.pieces(items).join(items.select("item_kind", "item_key", "max_chars", "overlap_chars", F.length("text").alias("n")), ["item_kind", "item_key"])
    per = p.groupBy("item_kind", "item_key", "max_chars", "overlap_chars", "n").agg(F.array_sort(F.collect_list(F.struct("piece_no", "char_start", "char_end", F.length("piece").alias("len")))).alias("ps"))
    ends = (F.col("ps")[0]["char_start"] == 0) & (F.element_at("ps", -1)["char_end"] == F.col("n"))
    sized = F.forall("ps", lambda x: (x["len"] == x["char_end"] - x["char_start"]) & (x["len"] <= F.col("max_chars")) & (x["len"] > 0))
    shared = F.forall(F.sequence(F.lit(1), F.size("ps") - 1), lambda i: F.col("ps")[i]["char_start"] == F.col("ps")[i - 1]["char_end"] - F.col("overlap_chars"))
    return per.groupBy("item_kind").agg(F.count("*").alias("items"), F.bool_and(ends).alias("whole"), F.bool_and(sized).alias("within_limit"), F.bool_and(shared).alias("overlap_kept"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return splitting.found(*(table(spark, root, t) for t in ("normalized_documents", "chunks", "split_limits")))


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.pieces(splitting.corpus_items(*(table(spark, root, t) for t in ("normalized_documents", "chunks", "split_limits"))))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return markup.found(table(spark, root, "normalized_documents"), table(spark, root, "chunks"))


def p4_clean(spark: SparkSession, root: str) -> DataFrame:
    return markup.cleaned(markup.items(table(spark, root, "normalized_documents"), table(spark, root, "chunks"), pages=True))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.found(table(spark, root, "normalized_documents"))


def p5_coverage(spark: SparkSession, root: str) -> DataFrame:
    return residue.coverage(table(spark, root, "normalized_documents"))


def p6_token_totals(spark: SparkSession, root: str) -> DataFrame:
    return token_budget.token_totals(table(spark, root, "chunks"), table(spark, root, "indexed_documents"))


def p6_fetched_budget(spark: SparkSession, root: str) -> DataFrame:
    return token_budget.fetched_budget(table(spark, root, "normalized_documents"), "2025-09-01 00:00:00")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return site_lines.found(table(spark, root, "normalized_documents"))


def p7_cleaned(spark: SparkSession, root: str) -> DataFrame:
    return site_lines.without_repeated_lines(table(spark, root, "normalized_documents"))


def p8_packed(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    sizes = tokens.with_tokens(docs.select("doc_id", "text").where("text is not null"), "text")
    return packing.pack(sizes, packing.capacities_of(table(spark, root, "container_sizes")), docs.count()).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers of each kind are."""
    sizes = table(spark, root, "container_sizes").select("container_kind", "capacity_tokens")
    packed = p8_packed(spark, root).groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return packed.join(sizes, "container_kind").select("container_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))


def _mix(spark: SparkSession, root: str, **how: object) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"), "source", "text").where("text is not null")
    # sizes are written once: the plan of the mix needs their sums before records are drawn
    return mixing.draw(cut_lineage(tokens.with_tokens(docs, "text")), table(spark, root, "mix_targets"), **how)


def p8_invariants(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the containers of each kind: every text once, none above its capacity, only larger texts cut, little space unused."""
    sizes = table(spark, root, "container_sizes").select("container_kind", "capacity_tokens")
    p = p8_packed(spark, root).join(F.broadcast(sizes), "container_kind")
    texts = p.groupBy("container_kind", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("size"), F.max("capacity_tokens").alias("capacity_tokens"))
    texts = texts.groupBy("container_kind").agg(F.count("*").alias("texts"), F.bool_and(F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens")))).alias("only_larger_cut"))
    held = p.groupBy("container_kind", "container_id", "capacity_tokens").agg(F.sum("tokens").alias("used"))
    # at most the open containers of a shard may be less than three quarters full
    loose = F.count_if(F.col("used") < 0.75 * F.col("capacity_tokens")) <= packing.OPEN * -(-table(spark, root, "documents").count() // packing.SHARD)
    held = held.groupBy("container_kind").agg(F.bool_and(F.col("used") <= F.col("capacity_tokens")).alias("within_capacity"), loose.alias("well_filled"))
    return texts.join(held, "container_kind")


def p9_invariants(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the selection for each listed source: its share within half a record, no record used more than allowed."""
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"), "source", "text").where("text is not null")
    records = cut_lineage(tokens.with_tokens(docs, "text"))
    targets = table(spark, root, "mix_targets")
    chosen, report = mixing.draw(records, targets)
    largest = records.groupBy("source").agg(F.max("tokens").alias("largest"))
    limits = targets.select("source", "max_repeats")
    r = report.join(limits, "source").join(largest, "source", "left").crossJoin(F.broadcast(report.agg(F.sum("drawn_tokens").alias("all_tokens"))))  # one row
    share = (F.col("weight") == 0) | (F.abs(F.col("drawn_tokens") - F.col("weight") * F.col("all_tokens")) <= F.coalesce("largest", F.lit(0)) + 0.001 * F.col("all_tokens"))
    return r.select("source", F.round("target_share", 9).alias("target_share"), F.col("largest").isNotNull().alias("has_text"), share.alias("share_reached"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"))


def p9_selection(spark: SparkSession, root: str) -> DataFrame:
    return _mix(spark, root)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return _mix(spark, root)[1]


def p9_even_as_targets(spark: SparkSession, root: str) -> DataFrame:
    """The sources' own shares, tempered to the entropy of the targets."""
    return _mix(spark, root, entropy_of_targets=True)[1]


def p9_tempered_selection(spark: SparkSession, root: str) -> DataFrame:
    """The records drawn at the sources' own shares, tempered to the entropy of the targets."""
    return _mix(spark, root, entropy_of_targets=True)[0].withColumnRenamed("id", "doc_id")


def p9_fixed_total(spark: SparkSession, root: str) -> DataFrame:
    """Shares for two million tokens, where the repeat limits bend the weights at the smaller scales."""
    return _mix(spark, root, total=2_000_000)[1]


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return same_look.found(table(spark, root, "documents"))


def p10_members(spark: SparkSession, root: str) -> DataFrame:
    return same_look.members(table(spark, root, "documents")).withColumnRenamed("id", "doc_id")


def p10_consistent(spark: SparkSession, root: str) -> DataFrame:
    return same_look.consistent(table(spark, root, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}


#: Host of a URL in DuckDB, as site_of gives it.
_SITE = "regexp_replace(regexp_extract(lower(trim({0})), '^(?:[a-z][a-z0-9+.\\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\\.', '')"
_PAGE = "coalesce(nullif(source_url, ''), url)"
_LANGUAGE = "regexp_extract(lower(trim(coalesce(language, ''))), '^([^-_]*)', 1)"


def _look_sql(text: str) -> str:
    """What looks the same, in SQL: every character by itself, then composition. Stated here anew, from Unicode's properties, apart from the operator's table."""
    import unicodedata as u

    #: Letters and signs that are drawn alike.
    given = "АВЕКМНОРСТУХЅІЈаеорсухѕіјԁԛԝһӏ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ" + "ՕՍօսհոց" + "\u2010\u2011\u2236\u0374\u02bc\u037e\u2024"
    drawn = "ABEKMHOPCTYXSIJaeopcyxsijdqwhl" + "ABEZHIKMNOPTYXoj" + "OUouhng" + "--:\u02b9\u2019;."
    one, none, more = dict(zip(given, drawn)), ["\u034f", "\u115f", "\u1160", "\u17b4", "\u17b5"], {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))):
        if u.category(c) == "Zs":
            one[c] = " "
        elif u.category(c) in ("Zl", "Zp"):
            one[c] = "\n"
        elif u.category(c) == "Cf" or "\ufe00" <= c <= "\ufe0f":
            none.append(c)
        elif u.decomposition(c).startswith(("<wide>", "<narrow>")) or "\ufb00" <= c <= "\ufb06":
            form = {"\uff9e": "\u3099", "\uff9f": "\u309a"}.get(c) or u.normalize("NFKC", c)
            if c not in none:
                (one if len(form) == 1 else more)[c] = form
    none = [c for c in none if c not in one]
    out = text
    for c, form in more.items():
        out = f"replace({out}, '{c}', '{form}')"
    # composed letters whose base has a look-alike
    composed = {}
    for c in map(chr, (*range(0x370, 0x590), *range(0x1F00, 0x2000))):
        apart = u.normalize("NFD", c)
        if len(apart) > 1 and apart[0] in one:
            composed[c] = u.normalize("NFC", one[apart[0]] + apart[1:])
    for c, form in composed.items():
        if len(form) > 1:
            out = f"replace({out}, '{c}', '{form}')"
        else:
            one[c] = form
    quoted = "".join(one.values()).replace("'", "''")
    return f"nfc_normalize(translate({out}, '{''.join(one)}{''.join(none)}', '{quoted}'))"


def oracle_sql() -> dict[str, str]:
    names = " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in LANGUAGE_NAMES.items())
    page, site = _PAGE, _SITE.format("page")
    lines = f"""
        docs AS (SELECT fetch_id, {page} AS page, markdown FROM normalized_documents WHERE markdown IS NOT NULL),
        cut AS (SELECT fetch_id, page, {site} AS site, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS line_no FROM docs),
        keyed AS (SELECT fetch_id, page, site, line_no, regexp_replace(lower(line), '[^\\p{{L}}]+', '', 'g') AS letters FROM cut),
        held AS (SELECT * FROM keyed WHERE length(letters) >= 15),
        sizes AS (SELECT site, count(DISTINCT page) AS pages FROM (SELECT page, {site} AS site FROM docs) GROUP BY site),
        shared AS (SELECT h.site, letters, count(DISTINCT page) AS on_pages FROM held h GROUP BY h.site, letters),
        repeated AS (SELECT s.site, s.letters, s.on_pages FROM shared s JOIN sizes z ON s.site = z.site WHERE on_pages >= 5 AND on_pages >= 0.1 * pages)"""
    return {
        # exact, over all pairs: the hashed search must find every one of them at the scale of this check
        "p1_found": """
            WITH v AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e FROM chunks WHERE chunk_level = 'child' AND embedding IS NOT NULL
                         AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
                 s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a, v b WHERE a.chunk_id <> b.chunk_id),
                 r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM s WHERE c >= 0.85)
            SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE n <= 5""",
        "p1_recall": """
            WITH v AS (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_level = 'child' AND embedding IS NOT NULL AND len(embedding) = 64
                         AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
                 a AS (SELECT * FROM v WHERE CAST('0x' || substr(md5(chunk_id), 1, 6) AS INTEGER) % 50 = 0)
            SELECT count(*) AS asked, CAST(count(*) * least(5, (SELECT count(*) FROM v) - 1) AS BIGINT) AS wanted, true AS enough FROM a""",
        "p2_found": r"""
            WITH w AS (SELECT DISTINCT chunk_id, list_distinct(regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}]+', 0)) AS w FROM chunks WHERE chunk_level = 'child'),
                 v AS (SELECT chunk_id, w, len(w) AS n FROM w WHERE len(w) >= 20)
            SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM v a JOIN v b ON a.chunk_id < b.chunk_id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n
            WHERE 10 * len(list_intersect(a.w, b.w)) >= 8 * (a.n + b.n - len(list_intersect(a.w, b.w)))""",
        "p10_found": f"""
            WITH f AS (SELECT doc_id, text, {_look_sql('text')} AS look FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
            SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text""",
        "p3_found": """
            SELECT 'markdown' AS item_kind, CAST(fetch_id AS VARCHAR) AS item_key FROM normalized_documents, split_limits WHERE item_kind = 'markdown' AND length(markdown) > max_chars
            UNION SELECT chunk_level, chunk_id FROM chunks, split_limits WHERE item_kind = chunk_level AND length(chunk_text) > max_chars""",
        "p6_token_totals": f"""
            WITH spans AS (SELECT DISTINCT document_id, least(token_start, token_end) AS lo, greatest(token_start, token_end) AS hi FROM chunks
                           WHERE token_start IS NOT NULL AND token_end IS NOT NULL AND document_id IS NOT NULL),
                 run AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY document_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM spans),
                 per AS (SELECT document_id, sum(greatest(0, hi - greatest(lo, before))) AS tokens FROM run GROUP BY document_id),
                 meta AS (SELECT document_id, {_SITE.format(page)} AS site,
                                 coalesce(nullif(CASE {_LANGUAGE} {names} ELSE {_LANGUAGE} END, ''), 'und') AS language FROM indexed_documents)
            SELECT language, site, count(*) AS documents, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS encoded_tokens FROM meta LEFT JOIN per USING (document_id) GROUP BY language, site""",
        "p3_invariants": """
            SELECT item_kind, count(*) AS items, true AS whole, true AS within_limit, true AS overlap_kept FROM (
                SELECT 'markdown' AS item_kind, CAST(fetch_id AS VARCHAR) AS k FROM normalized_documents, split_limits WHERE item_kind = 'markdown' AND length(markdown) > max_chars
                UNION SELECT chunk_level, chunk_id FROM chunks, split_limits WHERE item_kind = chunk_level AND length(chunk_text) > max_chars) GROUP BY item_kind""",
        "p7_cleaned": f"""WITH {lines}, gone AS (SELECT fetch_id, line_no FROM held JOIN repeated USING (site, letters)),
            kept AS (SELECT fetch_id, string_agg(line, chr(10) ORDER BY line_no) AS markdown FROM cut WHERE (fetch_id, line_no) NOT IN (SELECT fetch_id, line_no FROM gone) GROUP BY fetch_id),
            n AS (SELECT fetch_id, count(*) AS removed FROM gone GROUP BY fetch_id)
            SELECT d.fetch_id, CASE WHEN d.markdown IS NULL THEN NULL ELSE coalesce(kept.markdown, '') END AS markdown, CAST(coalesce(n.removed, 0) AS INTEGER) AS removed
            FROM normalized_documents d LEFT JOIN kept USING (fetch_id) LEFT JOIN n USING (fetch_id)""",
        "p8_invariants": """
            SELECT container_kind, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS texts, true AS only_larger_cut, true AS within_capacity, true AS well_filled FROM container_sizes""",
        "p9_invariants": """
            WITH own AS (SELECT source, sum(length(text)) AS n FROM documents WHERE text IS NOT NULL GROUP BY source)
            SELECT source, round(target_share, 9) AS target_share, n IS NOT NULL AS has_text, true AS share_reached, true AS repeats_kept FROM mix_targets LEFT JOIN own USING (source)""",
        "p10_members": f"""
            WITH f AS (SELECT doc_id, text, {_look_sql('text')} AS look FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY look, text) AS written_as, min(doc_id) OVER (PARTITION BY look) AS looks_like FROM f
            QUALIFY min(text) OVER (PARTITION BY look) <> max(text) OVER (PARTITION BY look)""",
        "p2_groups": r"""
            WITH RECURSIVE w AS (SELECT DISTINCT chunk_id AS id, list_sort(list_distinct(regexp_extract_all(lower(chunk_text), '[\p{L}\p{N}]+', 0))) AS w FROM chunks WHERE chunk_level = 'child' AND chunk_id IS NOT NULL),
                 c AS (SELECT w, len(w) AS n, min(id) AS rep FROM w WHERE len(w) >= 20 GROUP BY w),
                 e AS (SELECT a.rep AS a, b.rep AS b FROM c a JOIN c b ON a.rep <> b.rep AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n
                       WHERE 10 * len(list_intersect(a.w, b.w)) >= 8 * (a.n + b.n - len(list_intersect(a.w, b.w)))),
                 r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
                 g AS (SELECT a AS rep, min(b) AS group_id FROM r GROUP BY a), d AS (SELECT a AS rep, count(*) AS class_links FROM e GROUP BY a)
            SELECT w.id, g.group_id, coalesce(d.class_links, 0) AS class_links FROM w JOIN c USING (w) JOIN g USING (rep) LEFT JOIN d USING (rep)""",
        "p7_found": f"WITH {lines} SELECT fetch_id, CAST(line_no AS INTEGER) AS line_no FROM held JOIN repeated USING (site, letters)",
    }
