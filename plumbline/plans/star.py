"""Queries over the star schema, events, documents and embeddings: one or more for each operator of the library.

Inputs are built from whole tables. Doubles are rounded to six places in both engines, as sums run in another order.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import signif
from plumbline.operators import affiliations, companies, emotion, graph, neighbours, plotdata, rca, terms, topics
from plumbline.plans.registry import register
from plumbline.sources import patents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- specialization and affiliations -----------------------------------------------------------------


@register(
    "rca_fractional",
    """
WITH rows AS (SELECT DISTINCT l_orderkey AS id, p_type AS ipc, r_name AS region FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
              JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
k AS (SELECT id, count(DISTINCT region) AS k FROM rows GROUP BY id),
x AS (SELECT region, ipc, sum(1.0::DOUBLE / k) AS x FROM rows JOIN k USING (id) GROUP BY ALL),
m AS (SELECT *, sum(x) OVER (PARTITION BY region) AS r, sum(x) OVER (PARTITION BY ipc) AS c, sum(x) OVER () AS t FROM x)
SELECT region AS "Region", ipc AS "IPC", round(x, 6) AS "X_rc", round(r, 6) AS "X_r", round(c, 6) AS "X_c", round(x / r, 6) AS share_region, round(c / t, 6) AS share_global,
       round((x / r) / (c / t), 6) AS "RCA" FROM m
""",
)
def rca_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    # sizes decide between broadcast and shuffle: part and supplier grow with the data
    rows = (
        lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("l_orderkey").alias("id"), F.col("p_type").alias("ipc"), F.col("r_name").alias("region"))
    )
    return rounded(rca.rca_fractional(rows), "X_rc", "X_r", "X_c", "share_region", "share_global", "RCA")


@register(
    "split_affiliations",
    r"""
WITH s AS (SELECT s_suppkey AS eid, s_name || ', ' || n_name || ', ' || r_name || '.; ' || n_name || ' Univ, ' || r_name AS a FROM supplier JOIN nation ON n_nationkey = s_nationkey
           JOIN region ON r_regionkey = n_regionkey),
p AS (SELECT eid, regexp_replace(regexp_replace(unnest(string_split_regex(a, ';\s*')), '^\s+|\s+$', '', 'g'), '\.$', '') AS f FROM s)
SELECT eid, f AS affiliation_full, trim(string_split(f, ',')[1]) AS affiliation_name, CASE WHEN contains(f, ',') THEN trim(string_split(f, ',')[-1]) END AS country FROM p
""",
)
def split_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
        .select(F.col("s_suppkey").alias("EID"), F.concat("s_name", F.lit(", "), "n_name", F.lit(", "), "r_name", F.lit(".; "), "n_name", F.lit(" Univ, "), "r_name").alias("Affiliations"))
    )
    return affiliations.split_affiliations(rows)


# --- nested records ------------------------------------------------------------------------------------


@register("json_path_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return parsed.select("event_id", patents.extract("k", "bigint").alias("k"))


def patent_lines(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """A patent record for each order, as JSON lines: its lines' suppliers are the applicants, parts the inventors, part types the classes. In the order of lens_id as a number, if ordered."""
    lines = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "s_name", "n_name", "p_name", "p_type", "p_brand"))).alias("e"))
    )
    name = lambda c: F.struct(c.alias("value"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    biblio = F.struct(
        F.array(F.struct(F.lit("fr").alias("lang"), F.concat(F.lit("ordre "), "o_orderkey").alias("text")), F.struct(F.lit("en").alias("lang"), F.concat(F.lit("order "), "o_orderkey").alias("text"))).alias("invention_title"),
        F.struct(F.col("o_custkey").cast("string").alias("doc_number"), day.alias("date")).alias("application_reference"),
        F.struct(F.array(F.struct(day.alias("date"))).alias("claims")).alias("priority_claims"),
        F.struct(
            F.transform("e", lambda x: F.struct(name(x["s_name"]).alias("extracted_name"), x["n_name"].alias("residence"))).alias("applicants"),
            F.transform("e", lambda x: F.struct((x["l_linenumber"] + 10).alias("sequence"), name(x["p_name"]).alias("extracted_name"))).alias("inventors"),
        ).alias("parties"),
        F.struct(F.transform("e", lambda x: F.struct(x["p_type"].alias("symbol"), x["p_brand"].alias("classification_value"))).alias("classifications")).alias("classifications_ipcr"),
        F.struct(F.transform("e", lambda x: F.struct(x["p_type"].alias("symbol"), x["p_brand"].alias("classification_value"), F.lit("L").alias("classification_symbol_position"))).alias("classifications")).alias("classifications_cpc"),
    )
    record = F.struct(
        F.col("o_orderkey").cast("string").alias("lens_id"), F.lit("EP").alias("jurisdiction"), F.col("o_orderstatus").alias("kind"), day.alias("date_published"),
        F.struct(F.lit("de").alias("lang"), F.col("o_orderpriority").alias("text")).alias("abstract"), biblio.alias("biblio"),
        F.struct(F.col("o_orderstatus").alias("patent_status"), (F.col("o_orderstatus") == "F").alias("granted")).alias("legal_status"),
    )
    return (orders.orderBy("o_orderkey") if ordered else orders).select(F.to_json(record).alias("value"))


_LINES = """
l AS (SELECT l_orderkey, l_linenumber, s_name, n_name, p_name, p_type, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
"""


@register(
    "patents_flat",
    f"""
WITH {_LINES},
j AS (SELECT l_orderkey, string_agg(s_name, '; ' ORDER BY seq) AS applicants, string_agg(p_name, '; ' ORDER BY seq) AS inventors, string_agg(p_type, '; ' ORDER BY seq) AS ipc FROM l GROUP BY l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS lens_id, 'EP' AS jurisdiction, NULL::VARCHAR AS doc_number, o_orderstatus AS kind, strftime(o_orderdate, '%Y-%m-%d') AS date_published, NULL::VARCHAR AS lang,
       'order ' || o_orderkey AS title, o_orderpriority AS abstract, CAST(o_custkey AS VARCHAR) AS app_doc_number, strftime(o_orderdate, '%Y-%m-%d') AS app_date,
       strftime(o_orderdate, '%Y-%m-%d') AS priority_date, applicants, inventors, ipc AS ipc_classifications, o_orderstatus AS patent_status, o_orderstatus = 'F' AS granted, NULL::VARCHAR AS grant_date,
       0::BIGINT AS cited_by_count, NULL::BIGINT AS simple_family_size, NULL::BIGINT AS extended_family_size
FROM orders JOIN j ON l_orderkey = o_orderkey
""",
)
def patents_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.patent_info(patent_lines(spark, sf_dir))


@register("patent_applicants", f"WITH {_LINES} SELECT CAST(l_orderkey AS VARCHAR) AS lens_id, seq::INTEGER AS sequence, s_name AS name, n_name AS residence, NULL::VARCHAR AS address FROM l JOIN orders ON o_orderkey = l_orderkey")
def patent_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.applicants(patent_lines(spark, sf_dir))


@register("patent_inventors", f"WITH {_LINES} SELECT CAST(l_orderkey AS VARCHAR) AS lens_id, (l_linenumber + 10)::INTEGER AS sequence, p_name AS name, NULL::VARCHAR AS residence FROM l JOIN orders ON o_orderkey = l_orderkey")
def patent_inventors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.inventors(patent_lines(spark, sf_dir))


@register("patent_ipc", f"WITH {_LINES} SELECT CAST(l_orderkey AS VARCHAR) AS lens_id, 'IPCR' AS classification_system, p_type AS symbol, p_brand AS classification_value, seq::INTEGER AS sequence FROM l JOIN orders ON o_orderkey = l_orderkey")
def patent_ipc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.ipc_classes(patent_lines(spark, sf_dir))


@register("patent_cpc", f"WITH {_LINES} SELECT CAST(l_orderkey AS VARCHAR) AS lens_id, 'CPC' AS classification_system, p_type AS symbol, p_brand AS classification_value, 'L' AS classification_symbol_position, seq::INTEGER AS sequence FROM l JOIN orders ON o_orderkey = l_orderkey")
def patent_cpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.cpc_classes(patent_lines(spark, sf_dir))


def _files(spark: SparkSession, lines: DataFrame, **options: str) -> str:
    """A folder in the shared folder with the lines as text files, one a partition: the order of their names and of their lines is that of the lines."""
    path = f"{graph.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines.write.options(**options).text(path)
    return path


def _supplier_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, value): a record for each nation, whose suppliers are the applicants, and a line that is no record for each region."""
    who = F.struct(
        F.struct(F.col("s_name").alias("value")).alias("extracted_name"), F.when(F.col("s_acctbal") > 0, F.col("n_name")).alias("residence"),
        F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("Street "), "s_suppkey")).alias("extracted_address"),
    )
    nation = (
        table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .groupBy("n_nationkey", "n_name", "n_regionkey")
        .agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("s_suppkey").isNotNull(), F.struct("s_suppkey", who.alias("who"))))), lambda x: x["who"]).alias("who"))
    )
    claims = F.struct(F.when(F.col("n_regionkey") == 1, F.struct(F.lit("2001-01-01").alias("date"))).alias("earliest_claim"), F.array(F.struct(F.lit("2002-02-02").alias("date"))).alias("claims"))
    biblio = F.struct(
        F.when(F.col("n_regionkey") < 3, F.struct(F.lit("de").alias("lang"), F.col("n_name").alias("text"))).alias("invention_title"), claims.alias("priority_claims"),
        F.when(F.size("who") > 0, F.struct(F.col("who").alias("applicants"))).alias("parties"), F.when(F.col("n_regionkey") == 2, F.struct(F.col("n_nationkey").alias("patent_count"))).alias("cited_by"),
    )
    families = F.struct(F.struct(F.size("who").alias("size")).alias("simple_family"), F.struct((F.size("who") + 1).alias("size")).alias("extended_family"))
    good = nation.select(F.col("n_nationkey").alias("place"), F.to_json(F.struct(F.format_string("N%02d", F.col("n_nationkey").cast("int")).alias("lens_id"), F.col("n_name").alias("jurisdiction"), biblio.alias("biblio"), families.alias("families"))).alias("value"))
    bad = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 5).alias("place"), F.when(F.col("r_regionkey") == 0, F.lit("")).otherwise(F.concat(F.lit("{bad "), "r_name")).alias("value"))
    return good.union(bad)


_RECORDS = """
a AS (SELECT s_nationkey, string_agg(s_name, '; ' ORDER BY s_suppkey) AS applicants, count(*)::BIGINT AS n, string_agg(CASE WHEN s_acctbal > 5000 THEN 'Street ' || s_suppkey END, '; ' ORDER BY s_suppkey) AS addresses,
             string_agg(CASE WHEN s_acctbal > 0 THEN n_name END, '; ' ORDER BY s_suppkey) AS countries FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY s_nationkey),
p AS (SELECT n_nationkey AS place, printf('N%02d', n_nationkey) AS lens_id, n_name AS jurisdiction, CASE WHEN n_regionkey < 3 THEN n_name END AS title, CASE WHEN n_regionkey = 1 THEN '2001-01-01' ELSE '2002-02-02' END AS priority_date, applicants,
             CASE WHEN n_regionkey = 2 THEN n_nationkey ELSE 0 END::BIGINT AS cited_by_count, coalesce(n, 0)::BIGINT AS simple_family_size, coalesce(n, 0)::BIGINT + 1 AS extended_family_size, addresses AS applicant_addresses, countries AS applicant_countries
      FROM nation LEFT JOIN a ON s_nationkey = n_nationkey)
"""
_RECORD_COLUMNS = ["lens_id", "jurisdiction", "title", "priority_date", "applicants", "cited_by_count", "simple_family_size", "extended_family_size", "applicant_addresses", "applicant_countries"]


@register("patent_addresses", f"WITH {_RECORDS} SELECT {', '.join(_RECORD_COLUMNS)} FROM p")
def patent_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.patent_info(_supplier_records(spark, sf_dir).select("value"), addresses=True).select(*_RECORD_COLUMNS)


@register("patent_files", f"WITH {_RECORDS}, f AS (SELECT 'plain' AS file UNION ALL SELECT 'gzip') SELECT file, {', '.join(_RECORD_COLUMNS)} FROM p, f UNION ALL SELECT 'bad', CASE WHEN r_regionkey = 0 THEN '' ELSE '{{bad ' || r_name END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM region")
def patent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read from a plain and a gzip file, and the plain file's lines that are none."""
    lines = _supplier_records(spark, sf_dir).orderBy("place", "value").select("value")
    plain, packed = (patents.read_lines(spark, _files(spark, lines, **o)) for o in ({}, {"compression": "gzip"}))
    info = [patents.patent_info(x, addresses=True).select(F.lit(n).alias("file"), *_RECORD_COLUMNS) for n, x in (("plain", plain), ("gzip", packed))]
    bad = patents.bad_records(plain).select(F.lit("bad").alias("file"), F.col("value").alias("lens_id"))
    return info[0].union(info[1]).unionByName(bad, allowMissingColumns=True)


@register("patent_first_records", "SELECT CAST(o_orderkey AS VARCHAR) AS lens_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderkey LIMIT 100")
def patent_first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """max_records: the first hundred lines of the files of all records."""
    lines = patent_lines(spark, sf_dir, ordered=True)
    return patents.patent_info(patents.read_lines(spark, _files(spark, lines, compression="gzip"), max_records=100)).select("lens_id")


# --- terms of topics ---------------------------------------------------------------------------------------

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@register(
    "ngram_counts",
    rf"""
WITH d AS (SELECT source, list_filter({_WORDS}, lambda w: length(w) >= 3) AS w FROM documents),
t AS (SELECT source, unnest(w) AS term FROM d UNION ALL SELECT source, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d)
SELECT source, term, count(*) AS n FROM t GROUP BY ALL
""",
)
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)
    return terms.term_counts(table(spark, sf_dir, "documents").select("source", words.alias("words")), "source", "words", 1, 2).select("source", "term", F.col("tf").alias("n"))


_TFIDF = rf"""
d AS (SELECT source AS topic, list_filter({_WORDS}, lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '\p{{N}}+')) AS w FROM documents WHERE text <> ''),
t AS (SELECT topic, unnest(w) AS term FROM d UNION ALL SELECT topic, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
c AS (SELECT topic, term, count(*) AS n FROM t GROUP BY ALL),
f AS (SELECT *, count(*) OVER (PARTITION BY term) AS n_topics_with_term, (SELECT count(DISTINCT topic) FROM c) AS T FROM c),
i AS (SELECT topic, term, n, n_topics_with_term, ln((1.0::DOUBLE + T) / (1.0::DOUBLE + n_topics_with_term)) + 1 AS idf FROM f),
s AS (SELECT *, n * idf AS tfidf, max(n >= 2) OVER (PARTITION BY topic) AS enough FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(tfidf, 9) DESC, n DESC, term) AS rank FROM s WHERE n >= 2 OR NOT enough)
"""


@register("topic_tfidf_topn", f"WITH {_TFIDF} SELECT topic, term, n, n_topics_with_term, round(idf, 6) AS idf, round(tfidf, 6) AS tfidf, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def topic_tfidf_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(terms.topic_tfidf(table(spark, sf_dir, "documents"), topic_col="source", max_ngram=2), "idf", "tfidf")


_STOP = ["THE", "and", "not there"]
_COUNTED = _TFIDF.replace("WHERE text <> ''", "WHERE text <> '' AND source NOT IN ('src1', 'src2')").replace("c AS (SELECT topic, term, count(*) AS n FROM t", "c AS (SELECT topic, term, count(*) AS n FROM t WHERE term NOT IN ('the', 'and', 'not there')")
_COUNTED = _COUNTED.replace("n * idf AS tfidf", "n::DOUBLE AS tfidf")


@register("topic_counts_topn", f"WITH {_COUNTED} SELECT topic, term, n, n_topics_with_term, NULL::DOUBLE AS idf, tfidf, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def topic_counts_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts instead of TF-IDF, without some words and topics."""
    return terms.topic_tfidf(table(spark, sf_dir, "documents"), topic_col="source", max_ngram=2, top_n=5, use_tfidf=False, stopwords=_STOP, exclude_topics=["src1", "src2", "none"])


@register(
    "topic_terms_corpus",
    rf"""
WITH p AS (SELECT DISTINCT doc_id, lang AS topic FROM documents),
x AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY text) AS text FROM (SELECT DISTINCT doc_id, text FROM documents) GROUP BY doc_id),
w AS (SELECT doc_id, list_filter({_WORDS}, lambda w: NOT regexp_full_match(w, '\p{{N}}+')) AS w FROM x),
b AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w) GROUP BY ALL),
a AS (SELECT term, count(*) AS df_corpus, sum(tf)::BIGINT AS tf_corpus FROM b GROUP BY term HAVING sum(tf) >= 5),
g AS (SELECT topic, term, sum(tf)::BIGINT AS tf FROM b SEMI JOIN a USING (term) JOIN p USING (doc_id) GROUP BY ALL),
o AS (SELECT g.*, a.df_corpus, a.tf_corpus, count(*) OVER (PARTITION BY term) AS n_topics_with_term, (sum(tf) OVER (PARTITION BY topic))::BIGINT AS total_tf_topic FROM g JOIN a USING (term)),
n AS (SELECT topic, count(*) AS n_docs_in_topic FROM p GROUP BY topic),
k AS (SELECT (SELECT count(DISTINCT doc_id) FROM b) AS nd, (SELECT count(DISTINCT topic) FROM p SEMI JOIN b USING (doc_id)) AS nt, (SELECT sum(tf_corpus)::DOUBLE FROM a) AS tok)
SELECT topic, term, tf, total_tf_topic, df_corpus, tf_corpus, n_topics_with_term, n_docs_in_topic, round(tf / (total_tf_topic + 1e-9::DOUBLE), 6) AS tf_norm,
       round(tf * ln(nd / (1.0::DOUBLE + df_corpus)), 6) AS tf_idf, round(tf / (n_docs_in_topic + 1e-9::DOUBLE) * ln(nt / (1.0::DOUBLE + n_topics_with_term)), 6) AS c_tf_idf,
       round(tf / (total_tf_topic + 1e-9::DOUBLE), 6) AS p_topic_term, round(tf_corpus / (tok + 1e-9::DOUBLE), 6) AS p_corpus_term,
       round(tf / (total_tf_topic + 1e-9::DOUBLE) / (tf_corpus / (tok + 1e-9::DOUBLE) + 1e-9::DOUBLE), 6) AS lift
FROM o JOIN n USING (topic), k
""",
)
def topic_terms_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = terms.topic_terms(table(spark, sf_dir, "documents"), topic_col="lang", max_ngram=2)
    return rounded(out, "tf_norm", "tf_idf", "c_tf_idf", "p_topic_term", "p_corpus_term", "lift")


# --- company names ----------------------------------------------------------------------------------------

_CLEAN_SQL = "lower(p_name || ' ' || p_brand || ' Holding B.V.')"
_CLEAN_SQL = f"regexp_replace({_CLEAN_SQL}, '{'|'.join(companies.LEGAL_FORMS)}', ' ', 'g')"
_CLEAN_SQL = rf"regexp_replace(regexp_replace({_CLEAN_SQL}, '[\p{{P}}-]', ' ', 'g'), '^\s+|\s+$', '', 'g')"
for _word, _short in companies.SHORT_FORMS.items():
    _CLEAN_SQL = rf"regexp_replace({_CLEAN_SQL}, '\b{_word}\b', '{_short}', 'g')"
_CLEAN_SQL = rf"regexp_replace(regexp_replace({_CLEAN_SQL}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_NAMES = rf"""
c AS (SELECT p_partkey AS key, p_name || ' ' || p_brand || ' Holding B.V.' AS "Initial_name", {_CLEAN_SQL} AS "Clean" FROM part),
n AS (SELECT *, array_to_string(list_sort(string_split_regex("Clean", ' +')), ' ') AS "Clean2" FROM c)
"""


def _company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit(" "), "p_brand", F.lit(" Holding B.V.")).alias("name"))


@register("company_clean", f'WITH {_NAMES} SELECT key, "Clean", "Clean2" FROM n')
def company_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _company_names(spark, sf_dir).select("key", companies.clean_name(F.col("name")).alias("Clean"))
    return clean.withColumn("Clean2", companies.sorted_tokens(F.col("Clean")))


@register(
    "company_match",
    f"""
WITH {_NAMES},
l AS (SELECT *, lead("Clean2") OVER o AS after, lead("Initial_name") OVER o AS name_after FROM n WINDOW o AS (ORDER BY "Clean2", key)),
h AS (SELECT key, ch, sum(a) AS a, sum(b) AS b FROM (SELECT key, unnest(string_split("Clean2", '')) AS ch, 1 AS a, 0 AS b FROM l UNION ALL SELECT key, unnest(string_split(after, '')), 0, 1 FROM l) GROUP BY ALL),
s AS (SELECT key, sum(a * b) / sqrt(sum(a * a)::DOUBLE * sum(b * b)::DOUBLE) AS cosine FROM h GROUP BY key)
SELECT "Initial_name", "Clean", "Clean2", CASE WHEN round(cosine, 12) >= 0.85 THEN name_after END AS "Matched" FROM l LEFT JOIN s USING (key)
""",
)
def company_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies.clean_and_match_companies(_company_names(spark, sf_dir), "name", tie_col="key")


_RULES = [(1, "ALL", ["^small", "brass|tin"], None, "Small Metals", 1), (2, "ANY", ["polished", "COPPER$"], None, "Polishers", 2), (2, "ALL", ["anodized"], "steel", "Anodic Steel", 3), (3, "ALL", ["e"], None, "Others", 4)]


@register(
    "company_rules",
    """
SELECT p_partkey, p_type, CASE WHEN regexp_matches(p_type, '^small', 'i') AND regexp_matches(p_type, 'brass|tin', 'i') THEN 'Small Metals'
    WHEN regexp_matches(p_type, 'polished', 'i') OR regexp_matches(p_type, 'COPPER$', 'i') THEN 'Polishers'
    WHEN regexp_matches(p_type, 'anodized', 'i') AND regexp_matches(p_type, 'steel', 'i') THEN 'Anodic Steel' WHEN regexp_matches(p_type, 'e', 'i') THEN 'Others' END AS canonical
FROM part
""",
)
def company_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, companies.RULE_SCHEMA)
    return companies.apply_company_rules(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", rules)


def _rule_names() -> list[tuple[int, str]]:
    """Names that the packaged rules are about: each rule's canonical name, its tokens' first texts one after another, and the same in capitals with more around them."""
    out = []
    for _, kind, tokens, _, canonical, _ in companies.builtin_rules():
        first = [re.sub(r"\\b|[\\^$().?*]", "", t.split("|")[0]) for t in tokens]
        out += [canonical, " ".join(first if kind == "ALL" else first[:1]), f"The {' & '.join(first).upper()} Group"]
    return list(enumerate(out))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rules_sql() -> str:
    usable = companies.usable_rules(sorted(companies.builtin_rules(), key=lambda r: (r[0], r[5])), strict=False)
    tests = (f" {'AND' if kind == 'ALL' else 'OR'} ".join(f"regexp_matches(name, {_quote(t)}, 'i')" for t in tokens) + f" THEN {_quote(canonical)}" for kind, tokens, _, canonical in usable)
    return f"SELECT id, name, CASE {' '.join(f'WHEN {t}' for t in tests)} END AS canonical FROM (VALUES {', '.join(f'({k}, {_quote(n)})' for k, n in _rule_names())}) v(id, name)"


@register("company_rules_builtin", _rules_sql())
def company_rules_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packaged rules over names of which every rule has its own."""
    names = spark.createDataFrame(_rule_names(), "id int, name string")
    return companies.apply_company_rules(names, "name", companies.load_company_rules(spark), strict=False)


@register("company_rules_customers", "SELECT name, NULL::VARCHAR AS canonical FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier)")
def company_rules_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packaged rules over customer and supplier names, none of which is a company that they know."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).union(table(spark, sf_dir, "supplier").select("s_name"))
    return companies.apply_company_rules(names, "name", companies.load_company_rules(spark), strict=False)


# --- graph --------------------------------------------------------------------------------------------------


def _trade(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """Nations, regions and suppliers as vertices; a nation is linked with its region, and suppliers are isolated."""
    nation = table(spark, sf_dir, "nation")
    edges = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey"))).distinct()
    return graph.Graph(nodes, edges)


_COMPONENTS = """
e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation),
c AS (SELECT src AS id, min(src) OVER (PARTITION BY dst) AS component FROM e UNION ALL SELECT dst, min(src) FROM e GROUP BY dst UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey FROM supplier)
"""


@register("connected_components", f"WITH {_COMPONENTS} SELECT id, component FROM c")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(_trade(spark, sf_dir))


@register("giant_component", f"WITH {_COMPONENTS}, g AS (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT id FROM c SEMI JOIN g USING (component)")
def giant_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.giant_component(_trade(spark, sf_dir)).vertices


_ROUNDS = 8
_TRADE = "e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), k0 AS (SELECT DISTINCT a AS id, a AS low FROM g)"
for _k in range(_ROUNDS):  # labels spread along edges; every path of this graph is shorter than the rounds
    _TRADE += f", k{_k + 1} AS MATERIALIZED (SELECT k.id, least(k.low, min(n.low)) AS low FROM k{_k} k JOIN g ON g.a = k.id JOIN k{_k} n ON n.id = g.b GROUP BY k.id, k.low)"


def _lines_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    """Suppliers and parts linked by all lines."""
    lines = table(spark, sf_dir, "lineitem")
    ends = [lines.select(c).where(f"{c} is not null").distinct().select(F.concat(F.lit(kind), c).alias("id")) for kind, c in (("s", "l_suppkey"), ("p", "l_partkey"))]
    return graph.Graph(ends[0].union(ends[1]), lines.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")))


@register("connected_components_trade", f"WITH {_TRADE} SELECT id, low AS component FROM k{_ROUNDS}")
def connected_components_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(_lines_graph(spark, sf_dir))


@register("giant_component_trade", f"WITH {_TRADE}, t AS (SELECT low FROM k{_ROUNDS} GROUP BY low ORDER BY count(*) DESC, low LIMIT 1) SELECT id FROM k{_ROUNDS} SEMI JOIN t USING (low)")
def giant_component_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.giant_component(_lines_graph(spark, sf_dir)).vertices


# --- neighbours and topics -------------------------------------------------------------------------------------

_KNN = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, 1 - list_cosine_similarity(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d QUALIFY rank <= 15)
"""


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.knn(table(spark, sf_dir, "embeddings"), 15, "vec_id")


@register("knn_cosine", f"WITH {_KNN} SELECT id, neighbour, round(distance, 6) AS distance, rank::INTEGER AS rank FROM k")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_knn(spark, sf_dir), "distance")


@register("core_distance", f"WITH {_KNN} SELECT id, round(distance, 6) AS core FROM k WHERE rank = 9")
def core_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.core_distances(_knn(spark, sf_dir), 10), "core")


@register(
    "mutual_reachability",
    f"""WITH {_KNN}, c AS (SELECT id, distance AS core FROM k WHERE rank = 9)
SELECT k.id, neighbour, round(distance, 6) AS distance, rank::INTEGER AS rank, round(greatest(distance, a.core, b.core), 6) AS mutual_reachability FROM k JOIN c a ON a.id = k.id JOIN c b ON b.id = neighbour""",
)
def mutual_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.mutual_reachability(_knn(spark, sf_dir), 10), "distance", "mutual_reachability")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("string").alias("text"))


@register("identify_topics")
def identify_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.identify_topics(_vectors(spark, sf_dir)).documents


@register("identify_topics_coord")
def identify_topics_coord(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.identify_topics(_vectors(spark, sf_dir), n_components=2, assign_by_membership=True).coordinates


@register("identify_topics_grid")
def identify_topics_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.identify_topics_grid(_vectors(spark, sf_dir), {"given": None}, [15], [2, 5], [5, 10])


# --- emotion --------------------------------------------------------------------------------------------------


@register(
    "predict_vad",
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, t, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n FROM d)
SELECT doc_id, round(CASE WHEN n > 0 THEN length(regexp_replace(t, '[^aeiouAEIOU]', '', 'g')) / n::DOUBLE ELSE 0 END, 6) AS valence,
       round(CASE WHEN n > 0 THEN length(regexp_replace(t, '[^A-Z]', '', 'g')) / n::DOUBLE ELSE 0 END, 6) AS arousal,
       round(least(1.0, length(regexp_replace(t, '[^!?]', '', 'g')) * 100.0::DOUBLE / greatest(length(t), 1)), 6) AS dominance FROM l
""",
)
def predict_vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(emotion.predict_vad(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "valence", "arousal", "dominance")


# --- plot tables -----------------------------------------------------------------------------------------------


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts by part brand and size: scores with ties."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("p_brand").alias("topic"), F.concat(F.lit("size "), "p_size").alias("word")).agg(F.count("*").cast("double").alias("score"))


_SCORES = "s AS (SELECT p_brand AS topic, 'size ' || p_size AS word, count(*)::DOUBLE AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


@register(
    "topic_top_words_ties",
    f"""WITH {_SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY topic ORDER BY score DESC) AS r FROM s QUALIFY r <= 10)
SELECT topic, word, score, row_number() OVER (PARTITION BY topic ORDER BY score, word DESC)::INTEGER AS panel_order FROM r""",
)
def topic_top_words_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.top_topic_words(_scores(spark, sf_dir))


@register(
    "topic_terms_grid",
    f"""WITH {_SCORES}, t AS (SELECT topic FROM s GROUP BY topic ORDER BY topic LIMIT 6),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, word) AS r FROM s SEMI JOIN t USING (topic) QUALIFY r <= 10)
SELECT topic, word AS term, score AS value, row_number() OVER (PARTITION BY topic ORDER BY score, word DESC)::INTEGER AS panel_order FROM r""",
)
def topic_terms_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.topic_terms_grid(_scores(spark, sf_dir).withColumnsRenamed({"word": "term", "score": "tfidf"}))[0]


@register(
    "topic_words_chosen",
    f"""WITH {_SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY topic ORDER BY score DESC) AS r FROM s WHERE topic IN ('Brand#13', 'Brand#2') QUALIFY r <= 3)
SELECT topic, word, score, row_number() OVER (PARTITION BY topic ORDER BY score, word DESC)::INTEGER AS panel_order FROM r""",
)
def topic_words_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.top_topic_words(_scores(spark, sf_dir), topics=["Brand#2", "Brand#13", "none"], n_words=3)


def _first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_scores with the first order of each brand's size, and counts as integers."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("p_brand").alias("topic"), F.concat(F.lit("size "), "p_size").alias("term")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("seen"))


_SEEN = "s AS (SELECT p_brand AS topic, 'size ' || p_size AS term, count(*) AS n, min(l_orderkey) AS seen FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


@register(
    "topic_grid_first_seen",
    f"""WITH {_SEEN}, t AS (SELECT topic FROM s GROUP BY topic ORDER BY min(seen), topic LIMIT 5),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS r FROM s SEMI JOIN t USING (topic) QUALIFY r <= 4)
SELECT topic, term, n AS value, row_number() OVER (PARTITION BY topic ORDER BY n, term DESC)::INTEGER AS panel_order, (SELECT ceil(sqrt(count(*)))::INTEGER FROM t) AS grid_columns FROM r""",
)
def topic_grid_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics that appear first, by counts, with the number of columns of the grid."""
    grid, columns = plotdata.topic_terms_grid(_first_seen(spark, sf_dir), n_topics=5, n_terms=4, metric="n", order_col="seen")
    return grid.withColumn("grid_columns", F.lit(columns))


@register(
    "topic_grid_chosen",
    f"""WITH {_SEEN}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS r FROM s WHERE topic IN ('Brand#13', 'Brand#2') QUALIFY r <= 4)
SELECT topic, term, n AS value, row_number() OVER (PARTITION BY topic ORDER BY n, term DESC)::INTEGER AS panel_order, (SELECT ceil(sqrt(count(DISTINCT topic)))::INTEGER FROM r) AS grid_columns FROM r""",
)
def topic_grid_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, columns = plotdata.topic_terms_grid(_first_seen(spark, sf_dir), n_terms=4, metric="n", topics=["Brand#2", "none", "Brand#13"])
    return grid.withColumn("grid_columns", F.lit(columns))


_WRAPPED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '(\S{20,}|.{1,20})(?:\s+|$)', '\1<br>', 'g'), '<br>$', '')"


@register(
    "topic_tooltips",
    f"""SELECT doc_id, n_chars::DOUBLE AS x, doc_id::DOUBLE AS y, length(lang)::INTEGER AS cluster, 'a ' || lang AS topic_label, 'Doc: ' || doc_id || '<br>Topic: a ' || lang || '<br>Text: ' || coalesce({_WRAPPED}, '') AS tooltip
FROM (SELECT DISTINCT ON (doc_id) doc_id, n_chars, lang, text FROM documents)""",
)
def topic_tooltips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tooltips with shortened and wrapped texts, and labels from a table without ids."""
    docs = table(spark, sf_dir, "documents")
    places = docs.select("doc_id", F.col("n_chars").cast("double").alias("dim_1"), F.col("doc_id").cast("double").alias("dim_2"), F.col("lang"), F.char_length("lang").alias("cluster"))
    points, _ = plotdata.topic_space(places.drop("lang"), text=docs.select("doc_id", "text"), max_chars=60, wrap_width=20)
    named = places.select("doc_id", F.concat(F.lit("a "), "lang").alias("label"))
    own = points.join(named, "doc_id")
    return own.withColumn("tooltip", F.replace("tooltip", F.concat(F.lit("Topic: "), "topic_label", F.lit("<br>Text")), F.concat(F.lit("Topic: "), "label", F.lit("<br>Text")))).withColumn("topic_label", F.col("label")).drop("label")


@register("signif_prices", "SELECT p_partkey, round(round(p_retailprice / pow(10.0::DOUBLE, floor(log10(p_retailprice)) - 2)) * pow(10.0::DOUBLE, floor(log10(p_retailprice)) - 2), 6) AS price, CASE WHEN p_size > 10 THEN round(p_size / 10.0::DOUBLE) * 10 ELSE p_size END::DOUBLE AS size FROM part")
def signif_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") > 10, signif(F.col("p_size").cast("double"), 1)).otherwise(F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(signif(F.col("p_retailprice")), 6).alias("price"), size.alias("size"))


def _coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.get(v, F.lit(0)).alias("dim_1"), F.get(v, F.lit(1)).alias("dim_2"), F.col("label").cast("int").alias("cluster"))


_LABELS = {1: "first", 2: "second"}
_LABEL_SQL = "CASE label WHEN 0 THEN 'Noise' WHEN 1 THEN 'Topic 1: first' WHEN 2 THEN 'Topic 2: second' ELSE 'Topic ' || label END"


@register("topic_points", f"SELECT vec_id AS doc_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, label::INTEGER AS cluster, {_LABEL_SQL} AS topic_label FROM embeddings")
def topic_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, _ = plotdata.topic_space(_coordinates(spark, sf_dir), topic_labels=_LABELS)
    return rounded(points.drop("tooltip"), "x", "y")


@register(
    "topic_centroids",
    f"""SELECT {_LABEL_SQL} AS topic_label, label::INTEGER AS cluster, round(median(embedding[1]::DOUBLE), 6) AS x, round(median(embedding[2]::DOUBLE), 6) AS y, count(*) AS n_docs
FROM embeddings WHERE label <> 0 GROUP BY ALL""",
)
def topic_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plotdata.topic_space(_coordinates(spark, sf_dir), topic_labels=_LABELS)[1], "x", "y")


@register(
    "reorder_within",
    f"""WITH {_SCORES}, k AS (SELECT word || '___' || topic AS key, topic, avg(score) AS key_value FROM s GROUP BY ALL)
SELECT key, split_part(key, '___', 1) AS label, key_value, row_number() OVER (PARTITION BY topic ORDER BY key_value, key)::INTEGER AS key_order FROM k""",
)
def reorder_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = plotdata.reorder_within(_scores(spark, sf_dir), "word", "score", "topic")
    return keyed.select("key", plotdata.strip_reordered(F.col("key")).alias("label"), "key_value", "key_order")


@register("adjacent_rows", "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order FROM orders")
def adjacent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(own).alias("next_order"))
