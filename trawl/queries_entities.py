"""Registered queries over suppliers, nations and regions as entities: names, hybrid search, records, notes, prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import text as tx
from trawl.operators import graph
from trawl.operators.dense import LSAEncoder, VectorIndex
from trawl.operators.names import NameMatcher
from trawl.operators.rerank import DEFAULT_WEIGHTS
from trawl.operators.runs import ranked
from trawl.plans import adjudicate, agent, answer, evaluate, export
from trawl.plans.pipeline import Pipeline
from trawl.queries import EDGES, NODES, bm25_run, bm25_sql, document_entities, edges_of, fold_sql, grams_sql, nodes_of, query, table, tokens_sql
from trawl.sources import records

# Names. The query set: the names of nations and regions; the corpus: they and the suppliers.

LEGAL_SQL = ", ".join(f"'{w}'" for w in tx.LEGAL)


def normalised_sql(x: str) -> str:
    words = f"list_filter(string_split(regexp_replace({fold_sql(x)}, '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({LEGAL_SQL}))"
    return f"coalesce(nullif(array_to_string({words}, ' '), ''), trim(regexp_replace({fold_sql(x)}, '[^a-z0-9 ]+', ' ', 'g')))"


def common_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence, by the textbook table, a row at a time."""
    cell = f"greatest(acc[j], prev[j + 1], prev[j] + (substring({a}, j, 1) = substring({b}, i, 1))::BIGINT)"
    row = f"list_reduce(range(1, length({a}) + 1), lambda acc, j: list_append(acc, {cell}), [0::BIGINT])"
    return f"list_reduce(range(1, length({b}) + 1), lambda prev, i: {row}, list_transform(range(0, length({a}) + 1), lambda z: 0::BIGINT))[-1]"


PLACES = f"""{NODES}, places AS (SELECT * FROM nodes WHERE schema <> 'Person'),
asks AS (SELECT id AS query_id, caption AS query FROM places WHERE schema = 'Organization')"""
NAMES_SQL = f"""{PLACES},
pairs AS (SELECT q.query_id, q.query, p.id AS doc_id, p.caption, {normalised_sql('q.query')} AS a, {normalised_sql('p.caption')} AS b FROM asks q, places p),
parts AS (SELECT *, list_sort(string_split(a, ' ')) AS wa, list_sort(string_split(b, ' ')) AS wb FROM pairs WHERE a <> ''),
cut AS (
  SELECT *, array_to_string(wa, ' ') AS sa, array_to_string(wb, ' ') AS sb, array_to_string(list_sort(list_distinct(list_intersect(wa, wb))), ' ') AS both_,
         array_to_string(list_sort(list_distinct(list_filter(wa, lambda x: NOT list_contains(wb, x)))), ' ') AS ra,
         array_to_string(list_sort(list_distinct(list_filter(wb, lambda x: NOT list_contains(wa, x)))), ' ') AS rb FROM parts),
lcs AS (SELECT *, {common_sql('sa', 'sb')} AS whole, CASE WHEN ra = '' OR rb = '' THEN 0 ELSE {common_sql('ra', 'rb')} END AS rest, length(both_) AS s, (both_ <> '')::INT AS gap FROM cut),
measured AS (
  SELECT query_id, doc_id, caption, 100 * jaro_winkler_similarity(a, b) AS jaro_winkler, CASE WHEN length(sa) + length(sb) = 0 THEN 100 ELSE 200.0::DOUBLE * whole / (length(sa) + length(sb)) END AS token_sort,
         CASE WHEN both_ <> '' AND (ra = '' OR rb = '') THEN 100 ELSE greatest(
           100 * (1 - (length(ra) + length(rb) - 2 * rest)::DOUBLE / (2 * (s + gap) + length(ra) + length(rb))),
           CASE WHEN gap = 1 THEN 100 * (1 - (1 + length(ra))::DOUBLE / (2 * s + 1 + length(ra))) ELSE 0 END,
           CASE WHEN gap = 1 THEN 100 * (1 - (1 + length(rb))::DOUBLE / (2 * s + 1 + length(rb))) ELSE 0 END) END AS token_set FROM lcs),
named AS (SELECT *, 0.45 * jaro_winkler + 0.30 * token_sort + 0.25 * token_set AS total FROM measured),
named_run AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, doc_id) AS rank FROM named)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_of(spark, sf_dir).where("schema <> 'Person'")


def asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).where("schema = 'Organization'").select(F.col("id").alias("query_id"), F.col("caption").alias("query"))


@query(f"""WITH {NAMES_SQL} SELECT query_id, doc_id, round(total::DECIMAL(18, 9), 1)::DOUBLE AS score, rank, caption AS matched_name,
round(jaro_winkler::DECIMAL(18, 9), 1)::DOUBLE AS jaro_winkler, round(token_sort::DECIMAL(18, 9), 1)::DOUBLE AS token_sort, round(token_set::DECIMAL(18, 9), 1)::DOUBLE AS token_set FROM named_run WHERE rank <= 8""")
def name_match(spark, sf_dir):
    return NameMatcher().index(places(spark, sf_dir)).matches(asks(spark, sf_dir), 8)


@query(f"WITH {NAMES_SQL} SELECT query_id, doc_id, round(total, 6) AS name_score FROM named WHERE doc_id LIKE 'N%'")
def entity_name_scores(spark, sf_dir):
    pool = asks(spark, sf_dir).join(places(spark, sf_dir).where("id LIKE 'N%'").select(F.col("id").alias("doc_id")), how="cross")
    return NameMatcher().index(places(spark, sf_dir)).score_entities(pool, asks(spark, sf_dir)).withColumn("name_score", F.round("name_score", 6))


HYBRID_SQL = f"""{NAMES_SQL}, texts AS (SELECT id AS doc_id, concat_ws(' ', caption, caption, country, topic) AS text FROM places), asked AS (SELECT query_id AS item_id, query AS text FROM asks),
{bm25_sql('lexical', 100, docs='texts', asks='asked')},
votes AS (SELECT query_id, doc_id, rank, 0 AS run FROM lexical UNION ALL SELECT query_id, doc_id, rank, 1 FROM named_run WHERE rank <= 100),
fused AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(run * 1000 + rank) AS met FROM votes GROUP BY ALL),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, met, doc_id) AS rank FROM fused)"""


@query(f"WITH {HYBRID_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM pool WHERE rank <= 20")
def hybrid_search(spark, sf_dir):
    """Words and names, fused."""
    found = Pipeline(places(spark, sf_dir), edges_of(spark, sf_dir), vectors=False).hybrid.search(asks(spark, sf_dir), k=20, pool=100)
    return found.withColumn("score", F.round("score", 6))


@query(f"""WITH {HYBRID_SQL}, f AS (
  SELECT query_id, doc_id, p.rank - 1 AS prior_rank, list_distinct({tokens_sql('query')}) AS q, list_distinct({tokens_sql('text')}) AS t, total / 100 AS name FROM pool p JOIN asks USING (query_id) JOIN texts USING (doc_id) JOIN named USING (query_id, doc_id) WHERE p.rank <= 100),
g AS (SELECT query_id, doc_id, prior_rank, {DEFAULT_WEIGHTS[0]} * len(list_intersect(q, t)) / len(q) + {DEFAULT_WEIGHTS[1]} * len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))) + {DEFAULT_WEIGHTS[2]} * name + {DEFAULT_WEIGHTS[4]}::DOUBLE / (1 + prior_rank) AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, prior_rank) AS rank FROM g)
SELECT query_id, id, caption, schema, CASE WHEN country IS NULL THEN [] ELSE [country] END AS countries, round(score, 4) AS score, rank FROM r JOIN places ON id = doc_id WHERE rank <= 5""")
def pipeline_search(spark, sf_dir):
    """The whole stack: two retrievers, fusion, explained reranking, hydration."""
    p = Pipeline(places(spark, sf_dir), edges_of(spark, sf_dir), vectors=False, learned=False)
    return p.hits(p.search(asks(spark, sf_dir), k=5)).select("query_id", "id", "caption", "schema", "countries", "score", "rank")


# Latent semantics with as many dimensions as the corpus has: then the cosines are those of the TF-IDF vectors themselves.


@query(f"""WITH d AS (SELECT unnest(['a', 'b']) || n_nationkey AS id, n_nationkey AS key, list_concat({tokens_sql('n_name')}, {grams_sql('n_name')}) AS f FROM nation),
tf AS (SELECT id, key, f, count(*) AS n FROM (SELECT id, key, unnest(f) AS f FROM d) GROUP BY ALL), df AS (SELECT f, count(*) AS df FROM tf GROUP BY f HAVING count(*) >= 2),
w AS (SELECT id, key, f, n * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (f)), u AS (SELECT id, key, f, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w)
SELECT q.key AS query_id, d.id AS doc_id, round(sum(q.w * d.w), 3) AS score FROM u q JOIN u d USING (f) WHERE q.id LIKE 'a%' GROUP BY ALL HAVING sum(q.w * d.w) > 0.0005""")
def lsa_search(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    docs = nation.select(F.explode(F.array(F.concat(F.lit("a"), "n_nationkey"), F.concat(F.lit("b"), "n_nationkey"))).alias("doc_id"), F.col("n_name").alias("text"))
    found = VectorIndex(LSAEncoder(dim=64)).index(docs).search(nation.select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("query")), 50)
    return found.where("score > 0.0005").select("query_id", "doc_id", F.round("score", 3).alias("score"))


# Records: from JSON lines to the store and back.

FIRMS = """
firms AS (SELECT s_suppkey AS k, s_name, 'T-' || s_suppkey AS s_code, n_name, n_nationkey AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("k"), "s_name", F.concat(F.lit("T-"), "s_suppkey").alias("s_code"), "n_name", F.col("n_nationkey").alias("n"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a default only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "/tmp/checkpoints"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {FIRMS}
SELECT 'entity' AS kind, 'S' || k AS id, 'Company' AS schema, CASE WHEN k % 2 = 0 THEN s_name || ' (new)' ELSE s_name END AS caption, NULL AS target, NULL AS role,
       concat_ws(' ', CASE WHEN k % 2 = 0 THEN s_name || ' (new)' ELSE s_name END, s_name, CASE WHEN k % 2 = 1 THEN s_code END, n_name, CASE WHEN k % 2 = 1 THEN s_code END) AS text, CASE WHEN k % 2 = 0 THEN 2 ELSE 4 END AS properties FROM firms
UNION ALL SELECT 'entity', 'E' || k, 'Ownership', 'E' || k, NULL, NULL, '', 0 FROM firms WHERE k % 5 = 0
UNION ALL SELECT 'relation', 'E' || k, 'Ownership', 'S' || k, 'N' || n, CASE WHEN k % 3 = 0 THEN 'owner' ELSE (k % 100)::VARCHAR END, NULL, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END FROM firms WHERE k % 5 <> 0""")
def ingested_records(spark, sf_dir):
    """Companies twice (an older record first), ownerships of which some lack an end, addresses, broken and empty lines."""
    f = firms(spark, sf_dir)

    def line(n: int, key, schema: str, caption, **properties):
        lists = F.map_filter(F.create_map(*(x for name, v in properties.items() for x in (F.lit(name), F.array(v)))), lambda _, v: F.get(v, F.lit(0)).isNotNull())
        rec = F.struct(F.concat(F.lit(key), F.col("k")).alias("id"), F.lit(schema).alias("schema"), caption.alias("caption"), lists.alias("properties"))
        return f.select(F.lit(n).alias("n"), "k", F.to_json(rec).alias("value"))

    null, odd = F.lit(None).cast("string"), F.col("k") % 2 == 1
    old = line(0, "S", "Company", F.col("s_name"), name=F.col("s_name"), country=F.col("n_name"), alias=F.when(odd, F.col("s_code")), registrationNumber=F.when(odd, F.col("s_code")))
    new = line(1, "S", "Company", F.concat("s_name", F.lit(" (new)")), name=F.col("s_name"), country=F.col("n_name")).where("k % 2 = 0")
    edge = line(2, "E", "Ownership", null, owner=F.concat(F.lit("S"), "k"), asset=F.when(F.col("k") % 5 != 0, F.concat(F.lit("N"), "n")), percentage=(F.col("k") % 100).cast("string"), role=F.when(F.col("k") % 3 == 0, F.lit("owner")))
    address = line(3, "A", "Address", F.col("n_name"), full=F.col("n_name"))
    broken = f.select(F.lit(4).alias("n"), "k", F.when(odd, F.lit('{"id": "x", ')).otherwise(F.lit("  ")).alias("value"))
    path, store = scratch(spark, "records"), records.Store(spark, scratch(spark, "store"))
    old.unionAll(new).unionAll(edge).unionAll(address).unionAll(broken).orderBy("n", "k").select("value").coalesce(1).write.text(path)
    records.load(store, path)
    entities = store.entities.select(F.lit("entity").alias("kind"), "id", "schema", "caption", null.alias("target"), null.alias("role"), F.col("search_text").alias("text"), F.size("properties").alias("properties"))
    return entities.unionAll(store.relations.select(F.lit("relation"), "id", "schema", "source_id", "target_id", "role", null, F.size("properties")))


# Entities with aliases and details, for what shows them.


def detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    def strings(*values):
        return F.array(*values).cast("array<string>")

    f = firms(spark, sf_dir)
    company = f.select(F.concat(F.lit("S"), "k").alias("id"), F.lit("Company").alias("schema"), F.concat_ws(" ", "s_name", "n_name").alias("caption"), strings("n_name").alias("countries"), strings().alias("topics"), strings(F.lit("tables"), F.lit("x")).alias("datasets"),
                       F.create_map(F.lit("alias"), strings("s_code", "s_name"), F.lit("registrationNumber"), strings("s_code", "n_name")).alias("properties"), F.concat_ws(" ", "s_name", "n_name").alias("search_text"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey"), F.lit("Organization"), F.col("n_name"), strings(), F.when(F.col("n_nationkey") % 2 == 0, strings(F.lit("role.pep"))).otherwise(strings()), strings(F.lit("tables")), F.create_map().cast("map<string,array<string>>"), F.col("n_name"))
    return company.unionAll(nation)


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return firms(spark, sf_dir).select(F.concat(F.lit("e"), "k").alias("id"), F.lit("Ownership").alias("schema"), F.concat(F.lit("S"), "k").alias("source_id"), F.concat(F.lit("N"), "n").alias("target_id"), F.create_map(F.lit("percentage"), F.array((F.col("k") % 100).cast("string"))).alias("properties"))


@query(f"""WITH {FIRMS}, l AS (
  SELECT 'S' || k AS id, '- owns [[' || n_name || ']] (' || k % 100 || ')' AS line, 'owns' AS p, n_name AS t, (k % 100)::VARCHAR AS d FROM firms
  UNION ALL SELECT 'N' || n, '- owned by [[' || s_name2 || ' ' || n_name || ']] (' || k % 100 || ')', 'owned by', s_name2 || ' ' || n_name, (k % 100)::VARCHAR FROM (SELECT *, replace(s_name, '#', ' ') AS s_name2 FROM firms)),
links AS (SELECT id, string_agg(line, chr(10) ORDER BY p, t, d) AS lines FROM l GROUP BY id)
SELECT 'Entities/Company/' || replace(s_name, '#', ' ') || ' ' || n_name || '.md' AS path,
       concat_ws(chr(10), '---', 'id: "S' || k || '"', 'schema: "Company"', 'aliases: ["' || s_code || '", "' || s_name || '"]', 'countries: ["' || n_name || '"]', 'topics: []', 'datasets: ["tables", "x"]', 'tags: ["schema/company", "list/tables", "list/x"]', '---', '', '# ' || s_name || ' ' || n_name, '',
         '| field | value |', '|---|---|', '| registrationNumber | ' || s_code || '; ' || n_name || ' |', '', '**Also listed as:** ' || s_code || '; ' || s_name, '', '## Relations', '', lines, '', 'Source: entity `S' || k || '`.', '') AS content FROM firms JOIN links ON id = 'S' || k
UNION ALL SELECT 'Entities/Organization/' || n_name || '.md',
       concat_ws(chr(10), '---', 'id: "N' || n_nationkey || '"', 'schema: "Organization"', 'aliases: []', 'countries: []', 'topics: [' || CASE WHEN n_nationkey % 2 = 0 THEN '"role.pep"' ELSE '' END || ']', 'datasets: ["tables"]', 'tags: ["schema/organization", ' || CASE WHEN n_nationkey % 2 = 0 THEN '"topic/role-pep", ' ELSE '' END || '"list/tables"]', '---', '', '# ' || n_name, '',
         CASE WHEN lines IS NOT NULL THEN '## Relations' || chr(10) || chr(10) || lines || chr(10) END, 'Source: entity `N' || n_nationkey || '`.', '') FROM nation LEFT JOIN links ON id = 'N' || n_nationkey""")
def vault_notes(spark, sf_dir):
    return export.notes(detailed(spark, sf_dir), owned(spark, sf_dir))


SHORTLIST_SQL = f"""{FIRMS}, run AS (SELECT 'N' || n AS query_id, k, s_name, s_code, n_name, row_number() OVER (PARTITION BY n ORDER BY k) AS rank FROM firms)"""


def shortlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = firms(spark, sf_dir).select(F.concat(F.lit("N"), "n").alias("query_id"), F.concat(F.lit("S"), "k").alias("doc_id"), (-F.col("k")).cast("double").alias("score"))
    return ranked(f, None)


@query(f"""WITH {SHORTLIST_SQL}, l AS (
  SELECT query_id, string_agg('[' || rank || '] ' || s_name || ' ' || n_name || ' | type=Company | countries=' || n_name || ' | aliases=' || s_code || '; ' || s_name || ' | registrationNumber=' || s_code || '; ' || n_name || ' | lists=tables,x', chr(10) ORDER BY rank) AS lines FROM run GROUP BY query_id),
p AS (SELECT query_id, 'QUERY: ' || caption || chr(10) || chr(10) || 'CANDIDATES (in retrieval order):' || chr(10) || lines AS prompt FROM l JOIN (SELECT 'N' || n_nationkey AS query_id, n_name AS caption FROM nation) USING (query_id))
SELECT query_id, prompt, sha1('m|low|' || prompt) AS key FROM p""")
def shortlist_prompts(spark, sf_dir):
    """Candidates with aliases and details, and the keys of their decisions."""
    q = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("query_id"), F.col("n_name").alias("query"))
    return adjudicate.keyed(adjudicate.prompts(q, shortlists(spark, sf_dir), detailed(spark, sf_dir)), "m").select("query_id", "prompt", "key")


DETAILS_SQL = f"WITH {FIRMS}, e AS (SELECT 'S' || k AS id, s_name || ' ' || n_name AS name, s_name, s_code, n_name FROM firms)"


@query(f"""{DETAILS_SQL} SELECT 'alias' AS family, s_code AS query, id AS relevant, name AS entity_caption FROM e WHERE false
UNION ALL SELECT 'partial', list_last(string_split(name, ' ')) || ' ' || n_name, id, name FROM e UNION ALL SELECT 'attribute', name || ' ' || s_code, id, name FROM e
UNION ALL SELECT 'noisy', NULL, id, name FROM e UNION ALL SELECT 'noisy', NULL, 'N' || n_nationkey, n_name FROM nation WHERE length(n_name) >= 8""")
def labelled_queries(spark, sf_dir):
    """All queries that can be made: of aliases (one each, picked by a hash) and misspellings only whom they are for."""
    rows = evaluate.build_queries(detailed(spark, sf_dir), 10_000_000).where("family <> 'alias'")
    return rows.select("family", F.when(F.col("family") != "noisy", F.col("query")).alias("query"), F.get("relevant", F.lit(0)).alias("relevant"), "entity_caption")


@query("""WITH h AS (SELECT 'R' || r_regionkey AS doc_id, 100.0 - r_regionkey AS score, r_regionkey + 1 AS rank, r_regionkey AS r FROM region),
m AS (SELECT 'N' || n_nationkey AS doc_id, score * 0.45 AS score, rank AS parent, row_number() OVER (ORDER BY rank, 'n' || n_nationkey) AS nth FROM nation JOIN h ON r = n_regionkey),
t AS (SELECT *, min(nth) OVER (PARTITION BY parent) - 1 AS before FROM m)
SELECT 'all' AS query_id, doc_id, round(score, 6)::DOUBLE AS score, rank FROM h UNION ALL SELECT 'all', doc_id, round(score, 6)::DOUBLE, (SELECT count(*) FROM h) + nth FROM t WHERE before < 12""")
def graph_expand_capped(spark, sf_dir):
    """Regions and their nations: no node's turn comes once twelve neighbours have been found."""
    hits = table(spark, sf_dir, "region").select(F.lit("all").alias("query_id"), F.concat(F.lit("R"), "r_regionkey").alias("doc_id"), (100.0 - F.col("r_regionkey")).alias("score"), (F.col("r_regionkey") + 1).cast("long").alias("rank"))
    found = graph.expand(hits, edges_of(spark, sf_dir).where("schema = 'Directorship'"), nodes_of(spark, sf_dir), max_extra=12)
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH {EDGES}, a AS (SELECT target_id AS id, source_id AS neighbour, id AS e FROM edges WHERE schema = 'Ownership'), {NODES}, v AS (SELECT a.*, row_number() OVER (PARTITION BY a.id ORDER BY e, neighbour) AS n FROM a) SELECT v.id, neighbour, caption FROM v JOIN nodes ON nodes.id = neighbour WHERE n <= 2")
def entity_view_limited(spark, sf_dir):
    ents = nodes_of(spark, sf_dir)
    return graph.view(ents.where("id LIKE 'N%'").select("id"), edges_of(spark, sf_dir).where("schema = 'Ownership'"), ents, 2).select("id", "neighbour", "caption")


# Texts.


@query(f"WITH {bm25_sql('run', 4)} SELECT query_id, doc_id, lang || ' ' || source AS caption, [source] AS datasets, left(text, 280) AS snippet, rank FROM run JOIN documents USING (doc_id)")
def gathered_evidence(spark, sf_dir):
    return answer.gather(bm25_run(spark, sf_dir, 6), document_entities(spark, sf_dir), 4).select("query_id", "doc_id", "caption", "datasets", "snippet", "rank")


@query("SELECT p_partkey, translate(lower(p_name), 'qwxjch', '') AS latin FROM part")
def transliterated_names(spark, sf_dir):
    """Names in Cyrillic letters with one Latin letter each come back in Latin ones."""
    name = F.translate(F.lower("p_name"), "qwxjch", "")
    return table(spark, sf_dir, "part").select("p_partkey", tx.transliterate(F.translate(name, "abvgdezijklmnoprstuf", "абвгдезийклмнопрстуф")).alias("latin"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['claim ' || doc_id] ELSE [] END AS uncited, 'list/' || lang || '-' || source AS tag FROM documents""")
def report_lines(spark, sf_dir):
    """Reports with a head, a cited line, an empty one, one that only leads on, and in every second a line without a citation."""
    claim = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n-  claim "), "doc_id")).otherwise(F.lit(""))
    report = F.concat(F.lit("All of it\n- known ["), "source", F.lit("]\n\nFurther:"), claim)
    return table(spark, sf_dir, "documents").select("doc_id", tx.uncited_lines(report).alias("uncited"), tx.tag("list", F.concat(F.upper("lang"), F.lit(" ?! "), "source", F.lit("!"))).alias("tag"))


STOP_SQL = ", ".join(f"'{w}'" for w in sorted(agent.STOPWORDS))
PLAN_SQL = rf"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations),
p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(t, '"([^"]+)"', 1), lambda x: trim(x)), lambda x: length(x) > 2) AS quoted,
  list_transform(regexp_extract_all(t, '\b([A-Z][\p{{L}}\p{{N}}_''-]+(?:\s+[A-Z][\p{{L}}\p{{N}}_''-]+){{0,3}})', 1), lambda r: list_filter(regexp_split_to_array(r, '\s+'), lambda w: w <> '')) AS runs,
  list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_''-]+'), lambda w: length(w) > 2 AND w NOT IN ({STOP_SQL})) AS content FROM t),
k AS (SELECT *, list_transform(runs, lambda r: list_filter(range(1, len(r) + 1), lambda i: lower(r[i]) NOT IN ({STOP_SQL}))) AS kept FROM p),
m AS (SELECT *, list_filter(list_transform(range(1, len(runs) + 1), lambda i: coalesce(array_to_string(runs[i][kept[i][1]:kept[i][-1]], ' '), '')), lambda x: length(x) > 3) AS mentions FROM k),
a AS (SELECT conv_id, turn, list_concat(quoted, list_concat(mentions, CASE WHEN len(content) > 0 THEN [array_to_string(content[1:10], ' ')] ELSE [] END)) AS pieces FROM m)
SELECT conv_id, turn, list_filter(pieces, lambda x, i: list_position(list_transform(pieces, lambda y: lower(y)), lower(x)) = i)[1:4] AS plan FROM a"""


@query(PLAN_SQL)
def plan_subqueries(spark, sf_dir):
    import pandas as pd

    def plans(batches):
        for b in batches:
            yield pd.DataFrame({"conv_id": b["conv_id"], "turn": b["turn"], "plan": [agent.plan(t or "") for t in b["text"]]})

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").mapInPandas(plans, "conv_id long, turn long, plan array<string>")


@query(f"""WITH {bm25_sql('run', 4)}, g AS (SELECT query_id, list(lang || ' ' || source ORDER BY rank) AS captions FROM run JOIN documents USING (doc_id) GROUP BY query_id),
v AS (SELECT query_id, captions, list_filter(['src' || query_id % 20 || ' x', 'en'], lambda q: len(list_filter(string_split(q, ' '), lambda w: length(w) > 3 AND len(list_filter(captions, lambda c: contains(c, w))) > 0)) = 0) AS bare FROM g)
SELECT query_id, 'no evidence for: ' || array_to_string(bare, ', ') AS reason, bare AS next FROM v""")
def evidence_critique(spark, sf_dir):
    """Whether the first four documents of a passage speak of a given source; two letters never count as evidence."""
    rows = bm25_run(spark, sf_dir, 4).join(document_entities(spark, sf_dir).select(F.col("id").alias("doc_id"), "caption"), "doc_id")
    found = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "caption"))).caption.alias("captions"))
    wanted = F.array(F.concat(F.lit("src"), F.col("query_id") % 20, F.lit(" x")), F.lit("en"))
    return found.select("query_id", agent.critique(wanted, F.col("captions")).alias("v")).select("query_id", "v.reason", "v.next")
