"""Queries over files, metadata, joins, encoders and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import naming
from cuesheet.operators import encoding, evaluation, folds, merging, selection
from cuesheet.sources import metadata, pages
from cuesheet.sources.tables import read_table
from workload.text import rounded

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _documents_with_labels(s, sf):
    marks = read_table(s, sf, "labels").withColumn("_labelled", F.lit(True))
    return read_table(s, sf, "documents").select("doc_id", "lang", "source").join(marks, "doc_id", "left")


def _filter_present(s, sf):
    episodes = _documents_with_labels(s, sf).withColumn("subtitles_exists", F.col("quality") == 1)
    return selection.with_subtitles(episodes).select("doc_id", "lang")


def _pattern_count(s, sf):
    names = read_table(s, sf, "pages").select(
        F.concat(F.lit("S"), F.regexp_extract("url", r"/(\d+)", 1), F.lit("_metadata.json")).alias("name"))
    return selection.season_metadata_files(names).agg(F.count(F.lit(1)).alias("files"))


def _path_codes(s, sf):
    name = F.concat(F.lit("Show s"), F.regexp_extract("url", r"/(\d+)", 1), F.lit("e"), (F.length("html") % 30).cast("string"), F.lit(".srt"))
    return read_table(s, sf, "pages").select("page_id", naming.season_number(name).alias("season"),
                                             naming.episode_number(name).alias("episode"))


def _title_match(s, sf):
    listed = read_table(s, sf, "pages").select("page_id", F.regexp_extract("url", r"/(\d+)", 1).cast("int").alias("n"))
    named = listed.select("page_id", (F.col("n") % 20).alias("episode"), F.concat(
        F.lit("Show E"), F.lpad((F.col("n") % 25).cast("string"), 2, "0"), F.lit(" x")).alias("title"))
    return named.select("page_id", naming.title_has_episode(F.col("title"), F.col("episode")).alias("matches"))


def _target_clean(s, sf):
    orders = read_table(s, sf, "orders")
    scored = orders.select("o_orderkey", (F.col("o_totalprice") / 40000).alias("rating"),
                           F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_custkey")).alias("votes"))
    return selection.clean_target(scored)


def _score_lookup(s, sf):
    known = read_table(s, sf, "customer").where(F.col("c_acctbal") >= 0).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    wanted = read_table(s, sf, "orders").select("o_orderkey", "o_custkey")
    return merging.lookup_ids(wanted, known, "o_custkey")


def _metadata_upsert(s, sf):
    rows = read_table(s, sf, "documents").select(
        "doc_id", (F.col("lang") == "en").alias("subtitles_exists"), F.lit(None).cast("string").alias("subtitles_full_path"))
    listing = read_table(s, sf, "labels").select("doc_id", F.concat(
        F.lit("S"), F.col("quality").cast("string"), F.lit("E"), F.col("toxic").cast("string")).alias("path"))
    return merging.upsert_listing(rows, listing, ["doc_id"])


def _missing_worklist(s, sf):
    episodes = _documents_with_labels(s, sf).select(
        "source", F.coalesce("_labelled", F.lit(False)).alias("subtitles_exists"),
        F.when(F.coalesce("_labelled", F.lit(False)), F.when(F.col("toxic") == 0, F.col("lang")).when(F.col("quality") == 1, F.lit(""))).alias("subtitles_full_path"))
    return merging.missing_worklist(episodes).groupBy("source").agg(F.count(F.lit(1)).alias("missing"))


def _event_shares(s, sf):
    """Share of each event type per user, as a map with at most one entry per type."""
    counts = read_table(s, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("user_id").agg(F.sum("n").alias("all"))
    shares = counts.join(total, "user_id").select("user_id", F.struct("event_type", (F.col("n") / F.col("all")).alias("v")).alias("e"))
    return shares.groupBy("user_id").agg(F.map_from_entries(F.collect_list("e")).alias("shares"))


def _vectors(s, sf):
    return read_table(s, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def _expand_fixed(s, sf):
    ragged = _vectors(s, sf).select("vec_id", F.slice("embedding", F.lit(1), 3 + F.col("label") % 3).alias("topics"))
    return rounded(encoding.expand_fixed(ragged, "topics", "topic", 4))


def _ordinal_encode(s, sf):
    parts = read_table(s, sf, "part").select("p_partkey", F.when(F.col("p_size") <= 45, F.col("p_name")).alias("p_name"))
    return encoding.ordinal_encode(parts, "p_name", ["p_partkey"])


def _impute_median(s, sf):
    accounts = read_table(s, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    return rounded(encoding.impute_median(accounts, ["c_acctbal"]))


def _impute_mode(s, sf):
    orders = read_table(s, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"))
    return encoding.impute_mode(orders, ["o_orderpriority"])


def _one_hot(s, sf):
    parts = read_table(s, sf, "part").select("p_partkey", "p_type")
    return encoding.one_hot(parts, "p_type", encoding.fit_categories(parts, "p_type"))


def _json_expand(s, sf):
    parsed = read_table(s, sf, "events").select("event_id", encoding.parse_dict(F.col("props"), "bigint").alias("props"))
    return encoding.expand_dict(parsed, "props", "props")


def _scored_lines(s, sf):
    items = read_table(s, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    parts = read_table(s, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    scored = items.join(parts, "l_partkey").withColumn("prediction", F.col("l_quantity") * F.col("p_retailprice"))
    return folds.with_hash_fold(scored, ["l_orderkey"])


def _metrics(s, sf):
    return evaluation.regression_metrics(_scored_lines(s, sf), "l_extendedprice", "prediction")


def _page_block_links(s, sf):
    return pages.block_links(read_table(s, sf, "pages"), "nav", ()).withColumn("links", F.concat_ws(" ", "links"))


QUERIES = {
    "json_map_explode": lambda s, sf: metadata.explode_json_map(read_table(s, sf, "events").select("event_id", "props"), "props", "bigint"),
    "json_expand": _json_expand,
    "page_links": lambda s, sf: pages.item_links(read_table(s, sf, "pages")),
    "page_link_counts": lambda s, sf: pages.page_summary(read_table(s, sf, "pages")),
    "page_block_links": _page_block_links,
    "filter_present": _filter_present,
    "pattern_count": _pattern_count,
    "path_code_extract": _path_codes,
    "title_code_match": _title_match,
    "sanitize_name": lambda s, sf: read_table(s, sf, "pages").select("page_id", naming.sanitise(F.col("url")).alias("name")),
    "substring_exists": lambda s, sf: selection.substring_exists(read_table(s, sf, "part"), "p_name", "widget"),
    "status_skip": lambda s, sf: selection.status_counts(selection.skip_status(read_table(s, sf, "orders"), "o_orderstatus", ["P", "N/A"]), "o_orderstatus"),
    "target_clean": _target_clean,
    "id_normalize": lambda s, sf: selection.normalise_ids(read_table(s, sf, "customer").select("c_custkey", "c_name"), "c_name", "Customer#"),
    "resume_anti_join": lambda s, sf: merging.not_yet_done(read_table(s, sf, "documents").select("doc_id", "lang"), read_table(s, sf, "labels"), "doc_id"),
    "metadata_upsert": _metadata_upsert,
    "score_lookup": _score_lookup,
    "missing_worklist": _missing_worklist,
    "expand_dict": lambda s, sf: rounded(encoding.expand_dict(_event_shares(s, sf), "shares", "share")),
    "expand_list": lambda s, sf: rounded(encoding.expand_list(_vectors(s, sf).drop("label"), "embedding", "emb")),
    "expand_fixed": _expand_fixed,
    "cardinality": lambda s, sf: encoding.cardinality_table(read_table(s, sf, "part"), ["p_name", "p_brand", "p_type"]).withColumnRenamed("column", "name"),
    "ordinal_encode": _ordinal_encode,
    "impute_median": _impute_median,
    "impute_mode": _impute_mode,
    "one_hot": _one_hot,
    "kfold_assign": lambda s, sf: folds.with_hash_fold(read_table(s, sf, "orders").select("o_orderkey"), ["o_orderkey"]),
    "group_kfold_assign": lambda s, sf: folds.with_group_fold(read_table(s, sf, "part").select("p_partkey", "p_brand"), "p_brand", spread=["p_partkey"]),
    "regression_metrics": lambda s, sf: rounded(_metrics(s, sf)),
    "cv_summary": lambda s, sf: rounded(evaluation.cv_summary(_metrics(s, sf))),
}

_NUM = r"regexp_extract(url, '/(\d+)', 1)"
_NAME = f"'Show s' || {_NUM} || 'e' || (length(html) % 30) || '.srt'"
_CODE = r"(?i)S(\d{1,2})E(\d{1,2})"


def _code(group: int) -> str:
    n = f"try_cast(nullif(regexp_extract({_NAME}, '{_CODE}', {group}), '') AS INT)"
    return f"CASE WHEN {n} = 0 THEN 1 ELSE {n} END"


_FOLD = "(('0x' || substr(md5('42|' || l_orderkey), 1, 8))::BIGINT % 5)::INT"
_METRICS = f"""m AS (SELECT {_FOLD} AS fold, l_extendedprice AS y, l_extendedprice - l_quantity * p_retailprice AS e
        FROM lineitem JOIN part ON l_partkey = p_partkey),
    metrics AS (SELECT fold, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(y) AS r2,
        1 - var_pop(e) / var_pop(y) AS explained_variance FROM m GROUP BY fold)"""

_SHOWN = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g')"
_HREF = r"""<a\b[^>]*?\shref\s*=\s*(?:"([^"]+)"|''([^'']+)'')"""
_VISIBLE = "regexp_replace({}, '<[^>]*>', '', 'g')"


def _href(html):
    """First link, in either kind of quotes."""
    return f"regexp_extract({html}, '{_HREF}', 1) || regexp_extract({html}, '{_HREF}', 2)"


def _decoded(text):
    for name, character in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", chr(160)), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{character}')"
    return f"trim({text})"


ORACLES = {
    "json_map_explode": "SELECT event_id, unnest(json_keys(props)) AS key, unnest(list_transform(json_keys(props), lambda k: json_extract(props, '$.' || k)::BIGINT)) AS value FROM events",
    "json_expand": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS props_k FROM events",
    "page_links": f"""SELECT page_id, pos::BIGINT AS pos, {_decoded(_href('item'))} AS href, {_decoded(_VISIBLE.format('item'))} AS title
        FROM (SELECT page_id, unnest(items) AS item, unnest(range(len(items))) AS pos
              FROM (SELECT page_id, regexp_extract_all({_SHOWN}, '(?is)<li\\b[^>]*>(.*?)</li>', 1) AS items FROM pages))""",
    "page_link_counts": f"""SELECT page_id, coalesce(nullif({_decoded(_href(_SHOWN))}, ''), 'N/A') AS first_href,
        len(regexp_extract_all({_SHOWN}, '{_HREF}'))::BIGINT AS links, len(regexp_extract_all({_SHOWN}, '(?is)<li\\b[^>]*>(.*?)</li>', 1))::BIGINT AS items,
        {_decoded(_VISIBLE.format(f"regexp_extract({_SHOWN}, '(?is)<h[1-6]\\b[^>]*>(.*?)</h[1-6]>', 1)"))} AS heading,
        contains(html, 'No subtitles found') AS no_result FROM pages""",
    "page_block_links": f"""WITH blocks AS (SELECT page_id, regexp_extract({_SHOWN}, '(?is)<nav\\b[^>]*>(.*?)</nav>', 1) AS body FROM pages)
        SELECT page_id, body <> '' AS found, len(regexp_extract_all(body, '{_HREF}'))::BIGINT AS n_links,
               array_to_string(list_transform(regexp_extract_all(body, '{_HREF}'), lambda t: {_decoded(_href('t'))}), ' ') AS links FROM blocks""",
    "filter_present": "SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1",
    "pattern_count": rf"SELECT count(*) AS files FROM pages WHERE regexp_matches('S' || {_NUM} || '_metadata.json', '^S\d{{1,2}}_metadata\.json$')",
    "path_code_extract": f"SELECT page_id, {_code(1)} AS season, {_code(2)} AS episode FROM pages",
    "title_code_match": f"SELECT page_id, {_NUM}::INT % 20 = {_NUM}::INT % 25 AND {_NUM}::INT % 20 > 0 AS matches FROM pages",
    "sanitize_name": r"""SELECT page_id, regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') AS name FROM pages""",
    "substring_exists": "SELECT count(*) > 0 AS found FROM part WHERE contains(p_name, 'widget')",
    "status_skip": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('P', 'N/A') GROUP BY 1",
    "target_clean": """SELECT o_orderkey, o_totalprice / 40000 AS rating, o_custkey AS votes FROM orders
        WHERE o_orderpriority <> '4-NOT SPECIFIED' AND o_totalprice / 40000 BETWEEN 1 AND 10""",
    "id_normalize": "SELECT c_custkey, try_cast(replace(c_name, 'Customer#', '') AS BIGINT) AS c_name FROM customer",
    "resume_anti_join": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "metadata_upsert": """SELECT d.doc_id, l.doc_id IS NOT NULL OR d.lang = 'en' AS subtitles_exists,
        CASE WHEN l.doc_id IS NOT NULL THEN 'S' || quality || 'E' || toxic END AS subtitles_full_path FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "score_lookup": """SELECT o_custkey, o_orderkey, c_mktsegment, c.c_custkey IS NULL AS missing
        FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey""",
    "missing_worklist": """SELECT source, count(*) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)
        WHERE l.doc_id IS NULL OR toxic = 1 AND quality = 1 GROUP BY source""",
    "expand_dict": "SELECT user_id, " + ", ".join(
        f"nullif(count(*) FILTER (event_type = '{t}'), 0) / count(*) AS share_{t}" for t in EVENT_TYPES) + " FROM events GROUP BY user_id",
    "expand_list": "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS emb_{i}" for i in range(64)) + " FROM embeddings",
    "expand_fixed": "SELECT vec_id, " + ", ".join(
        f"CASE WHEN label % 3 = 1 THEN embedding[{i + 1}]::DOUBLE ELSE 0.0 END AS topic_{i}" for i in range(4)) + " FROM embeddings",
    "cardinality": " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n FROM part" for c in ("p_name", "p_brand", "p_type")),
    "ordinal_encode": """SELECT p_partkey, coalesce(code, -1)::BIGINT AS p_name FROM part
        LEFT JOIN (SELECT p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part WHERE p_size <= 45)) c
        ON part.p_name = c.p_name AND p_size <= 45""",
    "impute_median": """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal
        ELSE (SELECT median(c_acctbal) FROM customer WHERE c_acctbal >= 0) END AS c_acctbal FROM customer""",
    "impute_mode": """SELECT o_orderkey, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority ELSE
        (SELECT o_orderpriority FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) END AS o_orderpriority FROM orders""",
    "one_hot": "SELECT p_partkey, " + ", ".join(f"(p_type = '{t}')::INT AS p_type_{t}" for t in PART_TYPES) + " FROM part",
    "kfold_assign": "SELECT o_orderkey, (('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT % 5)::INT AS fold FROM orders",
    "group_kfold_assign": """WITH g AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS r FROM part GROUP BY p_brand)
        SELECT p_partkey, p_brand, (CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END)::INT AS fold FROM part JOIN g USING (p_brand)""",
    "regression_metrics": f"""WITH {_METRICS} SELECT fold, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2,
        round(explained_variance, 6) AS explained_variance FROM metrics""",
    "cv_summary": f"WITH {_METRICS} " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std FROM metrics" for m in evaluation.METRICS),
}
