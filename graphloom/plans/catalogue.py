"""Registered queries of the core operators, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import extract
from ..functions import paths, text
from ..graph import CodeGraph
from ..operators import budget, evaluation, fresh, impact, imports, rank, resolve, search, summary, targets, traverse
from ..runtime import materialize, shared_dir
from ..schemas import DEFAULT_BUDGET, SYMBOLS
from ..sources import files
from ..sources.store import Store
from ..streaming import watch
from . import corpus
from . import projections as p

_Q: dict = {}
_S: dict[str, str] = {}

_SITES = """sites AS (SELECT DISTINCT src, dst, o, ln FROM (SELECT l_partkey AS src, l_orderkey AS o, l_linenumber AS ln,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND dst <> src)"""
_G = f"{_SITES}, g AS (SELECT DISTINCT src, dst FROM sites)"
_N = """n AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS rn FROM
  (SELECT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
   JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey) GROUP BY src, dst) WHERE rn <= 2)"""
#: The most connected part by edges out (the smallest of equals).
_BUSY = "busy AS (SELECT src FROM g GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"


def query(name: str, sql: str | None = None):
    def register(f):
        _Q[name] = f
        if sql:
            _S[name] = sql
        return f

    return register


def _busiest(edges):
    return edges.groupBy("src").count().orderBy(F.desc("count"), F.col("src").cast("long")).limit(1).select(F.col("src").alias("node"))


# ---------------------------------------------------------------- graph


@query("graph_nodes_by_kind", "SELECT CASE WHEN p_partkey % 8 = 0 THEN 'class' ELSE 'function' END AS kind, count(*)::BIGINT AS n FROM part GROUP BY 1")
def _(spark, d):
    return summary.by_kind(p.part_symbols(spark, d))


@query("graph_degree", f"WITH {_G} SELECT src::VARCHAR AS id, count(*)::BIGINT AS outs FROM g GROUP BY src")
def _(spark, d):
    return summary.out_degree(p.part_edges(spark, d))


@query("definition", "SELECT p_partkey::VARCHAR AS id, p_name AS name, p_brand AS owner, p_type AS file FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def _(spark, d):
    s = p.part_symbols(spark, d)
    wanted = s.agg(F.min("name")).first()[0]
    return targets.resolve_targets(s, wanted).select("id", "name", "owner", "file")


@query("target_narrowing", "WITH m AS (SELECT p_name AS a, p_brand AS b FROM part ORDER BY p_partkey LIMIT 1) SELECT p_partkey::VARCHAR AS id, p_name AS name, p_brand AS owner FROM part, m WHERE p_name = a AND p_brand = b")
def _(spark, d):
    s = p.part_symbols(spark, d)
    first = s.orderBy(F.col("id").cast("long")).select("name", "owner").first()
    return targets.resolve_targets(s, f"{first['owner']}::{first['name']}").select("id", "name", "owner")


@query("references", f"WITH {_SITES} SELECT src::VARCHAR AS from_id, ln AS site_line, p_name AS name FROM sites JOIN part ON p_partkey = src WHERE dst IN (SELECT p_partkey FROM part WHERE p_name = (SELECT min(p_name) FROM part))")
def _(spark, d):
    s, e = p.part_symbols(spark, d), p.call_edges(spark, d, bound=True)
    found = targets.references(s, e, targets.resolve_targets(s, s.agg(F.min("name")).first()[0]))
    return found.select("from_id", "site_line", "name")


def _walk_sql(incoming: bool, depth: int) -> str:
    a, b = ("dst", "src") if incoming else ("src", "dst")
    return f"""WITH RECURSIVE {_G}, {_BUSY}, r AS (SELECT src AS node, 0 AS depth FROM busy UNION SELECT g.{b}, depth + 1 FROM r JOIN g ON g.{a} = r.node WHERE depth < {depth})
SELECT node::VARCHAR AS id, min(depth)::INT AS depth FROM r WHERE node NOT IN (SELECT src FROM busy) GROUP BY node"""


@query("callers_d3", _walk_sql(True, 3))
def _(spark, d):
    e = p.part_edges(spark, d)
    return traverse.reach(e, _busiest(e), incoming=True, max_depth=3).withColumnRenamed("node", "id")


@query("callees_d3", _walk_sql(False, 3))
def _(spark, d):
    e = p.part_edges(spark, d)
    return traverse.reach(e, _busiest(e), max_depth=3).withColumnRenamed("node", "id")


_BLAST = f"WITH RECURSIVE {_G}, {_BUSY}, r AS (SELECT src AS node FROM busy UNION SELECT g.src FROM r JOIN g ON g.dst = r.node)"


@query("blast_radius", f"{_BLAST} SELECT node::VARCHAR AS id FROM r WHERE node NOT IN (SELECT src FROM busy)")
def _(spark, d):
    e = materialize(p.part_edges(spark, d), "edges")
    return traverse.reach(e, _busiest(e), incoming=True).select(F.col("node").alias("id"))


@query("reach_depth_histogram", f"SELECT depth, count(*)::BIGINT AS n FROM ({_walk_sql(False, 6)}) GROUP BY depth")
def _(spark, d):
    e = materialize(p.part_edges(spark, d), "edges")
    return traverse.reach(e, _busiest(e), max_depth=6).groupBy("depth").agg(F.count("*").alias("n"))


@query("dependency_edges", f"WITH {_N} SELECT a.n_name AS from_file, dst::VARCHAR AS import_text, CASE WHEN dst % 5 > 0 THEN b.n_name END AS to_file FROM n JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst")
def _(spark, d):
    nation = p.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("file"))
    e = p.nation_edges(spark, d).select(F.lit("imports").alias("kind"), F.col("src").cast("string").alias("from_id"), F.col("dst").cast("string").alias("to_name"), F.when(F.col("dst") % 5 > 0, F.col("dst").cast("string")).alias("to_id"))
    return traverse.dependencies(e, nation)


@query("dependency_cycles", f"""WITH RECURSIVE {_N}, r AS (SELECT src AS a, dst AS b FROM n UNION SELECT r.a, n.dst FROM r JOIN n ON n.src = r.b)
SELECT x.a AS node, min(x.b) AS component, count(*)::BIGINT AS size FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 0""")
def _(spark, d):
    return traverse.strong_components(p.nation_edges(spark, d)).select("node", "component", "size")


@query("container_walk", """SELECT 'o' || o_orderkey AS id, 3 AS depth, r_name AS root FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def _(spark, d):
    t = lambda n: p.table(spark, d, n)
    frames = [t("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("container"), F.lit(None).cast("string").alias("name")), t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("container"), F.lit(None).cast("string").alias("name")), t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("container"), F.lit(None).cast("string").alias("name")), t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("container"), F.col("r_name").alias("name"))]
    s = frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])
    tops = frames[3].select(F.col("id").alias("ancestor"), F.col("name").alias("root"))
    return traverse.container_walk(s).where("id like 'o%'").join(tops, "ancestor").select("id", F.col("hops").alias("depth"), "root")


# ---------------------------------------------------------------- search by structure and name


@query("structural_search_kind_owner", "SELECT p_partkey::VARCHAR AS id FROM part WHERE p_partkey % 8 = 0 AND lower(p_brand) = (SELECT lower(min(p_brand)) FROM part)")
def _(spark, d):
    s = p.part_symbols(spark, d)
    return search.structural_search(s, None, f"kind:CLASS owner:{s.agg(F.min('owner')).first()[0]}").select("id")


@query("structural_search_calls", f"WITH {_SITES}, w AS (SELECT split_part(min(p_name), ' ', 1) AS word FROM part) SELECT DISTINCT src::VARCHAR AS id FROM sites JOIN part ON p_partkey = dst, w WHERE contains(p_name, word)")
def _(spark, d):
    s = p.part_symbols(spark, d)
    return search.structural_search(s, p.call_edges(spark, d), f"calls:{s.agg(F.min('name')).first()[0].split()[0]}").select("id")


@query("structural_search_text", "WITH w AS (SELECT split_part(max(p_name), ' ', 1) AS word FROM part) SELECT p_partkey::VARCHAR AS id FROM part, w WHERE contains(lower(p_name || ' ' || p_type), lower(word))")
def _(spark, d):
    s = p.part_symbols(spark, d)
    return search.structural_search(s, None, s.agg(F.max("name")).first()[0].split()[0].upper()).select("id")


@query("suggest_names", """WITH t AS (SELECT min(p_name) || 's' AS w FROM part), n AS (SELECT DISTINCT p_name AS name, lower(p_name) AS low FROM part)
SELECT name, (CASE WHEN low = lower(w) THEN 0 WHEN contains(low, lower(w)) OR (length(low) >= 3 AND contains(lower(w), low)) THEN 1 + abs(length(low) - length(w)) ELSE 100 + levenshtein(low, lower(w)) END)::INT AS score
FROM n, t WHERE low = lower(w) OR contains(low, lower(w)) OR (length(low) >= 3 AND contains(lower(w), low)) OR levenshtein(low, lower(w)) <= greatest(2, length(w) // 3) ORDER BY score, name LIMIT 5""")
def _(spark, d):
    s = p.part_symbols(spark, d)
    return targets.suggest(s, "Any::" + s.agg(F.min("name")).first()[0] + "s")  # the last segment counts


# ---------------------------------------------------------------- binding

_BIND = f"""{_SITES}, b AS (SELECT o || ':' || ln || ':' || src || ':' || dst AS edge_id, src, t.p_name AS callee, CASE WHEN ln % 2 = 0 THEN t.p_brand END AS q, s.p_brand AS s_owner, s.p_type AS s_file
  FROM sites JOIN part t ON t.p_partkey = dst JOIN part s ON s.p_partkey = src),
c AS (SELECT b.*, p_partkey::VARCHAR AS c_id, p_brand AS c_owner, p_type AS c_file, 1 + CASE WHEN q = p_brand THEN 16 ELSE 0 END + CASE WHEN p_type = s_file THEN 4 ELSE 0 END AS score
  FROM b JOIN part ON p_name = callee AND p_partkey <> src AND p_partkey % 8 <> 0),
w AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY score DESC, c_id) AS rn, first_value(c_owner) OVER (PARTITION BY edge_id ORDER BY score DESC, c_id) AS wo,
  first_value(c_file) OVER (PARTITION BY edge_id ORDER BY score DESC, c_id) AS wf, max(score) OVER (PARTITION BY edge_id) AS best FROM c),
a AS (SELECT edge_id, max(best) AS best, any_value(q) AS q, min(CASE WHEN rn = 1 THEN c_id END) AS to_id, count(*) FILTER (WHERE score = best AND NOT (c_owner = wo AND c_file = wf))::INT AS alternatives FROM w GROUP BY edge_id),
bound AS (SELECT edge_id, to_id, alternatives, best::INT AS score FROM a WHERE NOT (q IS NOT NULL AND best < 9))"""


def _bound(spark, d):
    return resolve.bind(p.call_edges(spark, d), p.part_symbols(spark, d))


@query("bind_calls", f"WITH {_BIND} SELECT * FROM bound")
def _(spark, d):
    return _bound(spark, d)


@query("bind_ties", f"WITH {_BIND} SELECT alternatives, count(*)::BIGINT AS n FROM bound GROUP BY 1")
def _(spark, d):
    return _bound(spark, d).groupBy("alternatives").agg(F.count("*").alias("n"))


@query("bind_abstain", f"WITH {_BIND} SELECT edge_id FROM a WHERE q IS NOT NULL AND best < 9")
def _(spark, d):
    e, s = p.call_edges(spark, d), p.part_symbols(spark, d)
    return resolve.bind(e, s, abstain=False).select("edge_id").join(resolve.bind(e, s).select("edge_id"), "edge_id", "left_anti")


@query("resolution_stats", f"WITH {_BIND} SELECT (SELECT count(*) FROM b)::BIGINT AS sites, count(*)::BIGINT AS resolved, count(*) FILTER (WHERE alternatives > 0)::BIGINT AS ambiguous, (count(*) - count(*) FILTER (WHERE alternatives > 0)) / (SELECT count(*) FROM b)::DOUBLE AS confident FROM bound")
def _(spark, d):
    return resolve.statistics(resolve.resolve(p.call_edges(spark, d), p.part_symbols(spark, d)))


@query("scoped_rebind", f"WITH {_BIND} SELECT b.edge_id, x.to_id FROM b LEFT JOIN bound x USING (edge_id)")
def _(spark, d):
    """R16 over one file and one name equals a full resolve."""
    s = p.part_symbols(spark, d)
    done = materialize(resolve.resolve(p.call_edges(spark, d), s), "edges")
    touched = s.agg(F.min("file").alias("file"))
    return resolve.rebind_scope(done, s, touched, s.agg(F.max("name").alias("name"))).select("edge_id", "to_id")


@query("sole_implementor", f"""WITH {_SITES}, y AS (SELECT o || ':' || ln || ':' || src || ':' || dst AS edge_id, p_name || p_size AS callee, src FROM sites JOIN part ON p_partkey = dst),
z AS (SELECT edge_id, count(DISTINCT p_brand) AS owners, min(p_partkey::VARCHAR) AS to_id FROM y JOIN part ON p_name || p_size = callee AND p_partkey <> src AND p_partkey % 8 <> 0 GROUP BY edge_id)
SELECT edge_id, to_id FROM z WHERE owners = 1""")
def _(spark, d):
    """Calls through an interface; names with the size in them have few owners."""
    s = p.part_symbols(spark, d).withColumn("name", F.concat("name", "line_start"))
    iface = s.limit(1).select(*[F.lit({"id": "iface", "name": "Shape", "kind": "interface"}.get(c)).cast(s.schema[c].dataType).alias(c) for c in s.columns])
    names = s.select(F.col("id").alias("dst"), F.col("name").alias("to_name"))
    e = p.call_edges(spark, d).drop("to_name").withColumn("qualifier", F.lit("Shape")).withColumn("dst", F.element_at(F.split("edge_id", ":"), -1)).join(names, "dst")
    return resolve.bind(e, s.unionByName(iface)).select("edge_id", "to_id")


@query("import_evidence", r"""WITH s AS (SELECT doc_id, source, string_split_regex(coalesce(text, ''), '[:./{},"''\\ \s<>]+') AS seg FROM documents)
SELECT doc_id, (CASE WHEN list_contains(seg, 'the') THEN 3 WHEN list_contains(seg, 'of') THEN 2 ELSE 0 END)::INT AS score FROM s""")
def _(spark, d):
    docs = p.table(spark, d, "documents")
    return docs.select("doc_id", resolve.import_evidence(paths.import_segments(F.col("text")), F.lit("of/the.py")).alias("score"))


@query("path_normalise", r"""WITH u AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) || '/./a/../b/..' AS p FROM pages)
SELECT page_id, array_to_string(list_filter(list_filter(string_split(p, '/'), lambda s: s <> '' AND s <> '.')[1:-5], lambda s: true), '/') AS path FROM u""")
def _(spark, d):
    url = F.concat(F.regexp_extract("url", "://([^?#]*)", 1), F.lit("/./a/../b/.."))
    return p.table(spark, d, "pages").select("page_id", paths.normalise(url).alias("path"))


# ---------------------------------------------------------------- centrality


def _pagerank_sql(rounds: int, focus: bool) -> str:
    base = "SELECT p_partkey AS node, 1.0::DOUBLE / (SELECT count(*) FROM part) AS base FROM part"
    if focus:
        base = "SELECT p_partkey AS node, 0.1::DOUBLE / (SELECT count(*) FROM part) + CASE WHEN p_partkey BETWEEN 1 AND 3 THEN 0.9::DOUBLE / 3 ELSE 0 END AS base FROM part"
    parts = [f"b AS MATERIALIZED ({base}), deg AS MATERIALIZED (SELECT src, count(*) AS n FROM sites GROUP BY src), r0 AS MATERIALIZED (SELECT node, base AS r FROM b)"]
    for k in range(rounds):
        parts.append(f"f{k} AS (SELECT dst AS node, sum(r / n) AS f FROM sites JOIN deg USING (src) JOIN r{k} ON r{k}.node = src GROUP BY dst), i{k} AS (SELECT coalesce(sum(r), 0) AS i FROM r{k} WHERE node NOT IN (SELECT src FROM deg)), r{k + 1} AS MATERIALIZED (SELECT b.node, 0.15 * base + 0.85 * (coalesce(f, 0) + i * base) AS r FROM b LEFT JOIN f{k} ON f{k}.node = b.node, i{k})")
    return f"WITH {_SITES}, " + ", ".join(parts) + f" SELECT node::VARCHAR AS id, round(r, 8) AS rank FROM r{rounds}"


def _ranks(spark, d, focus=None):
    nodes = p.part_symbols(spark, d).select(F.col("id").alias("node"))
    sites = p.part_sites(spark, d).distinct()
    if focus:
        focus = spark.createDataFrame([(x,) for x in focus], "node string")
    return rank.pagerank(nodes, sites.select("src", "dst"), focus, rounds=10)


@query("pagerank_10", _pagerank_sql(10, False))
def _(spark, d):
    return _ranks(spark, d).select(F.col("node").alias("id"), F.round("rank", 8).alias("rank"))


@query("pagerank_focus", _pagerank_sql(10, True))
def _(spark, d):
    return _ranks(spark, d, ["1", "2", "3"]).select(F.col("node").alias("id"), F.round("rank", 8).alias("rank"))


@query("repo_summary_files", "SELECT p_type AS file, count(*)::BIGINT AS symbols FROM part GROUP BY 1 ORDER BY symbols DESC, file LIMIT 15")
def _(spark, d):
    return summary.largest_files(p.part_symbols(spark, d))


_SUMMARY = f"""WITH bound AS (SELECT DISTINCT lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS d, l_partkey AS s FROM lineitem QUALIFY d IS NOT NULL AND d <> s), m AS ({_pagerank_sql(10, False)}),
x AS (SELECT id, rank, (strlen(p_name) + strlen(p_name || ' ' || p_type) + strlen(p_type) + strlen(p_brand) + 10 + 64) // 4 + 1 AS cost FROM m JOIN part ON p_partkey::VARCHAR = id WHERE p_partkey IN (SELECT d FROM bound) ORDER BY rank DESC, id LIMIT 50),
b AS (SELECT 1000 - least(500, (sum(strlen(l) + 8) + 256) // 4 + 1) AS most FROM (SELECT DISTINCT lower(p_type) AS l FROM part)),
y AS (SELECT *, sum(cost) OVER (ORDER BY rank DESC, id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (ORDER BY rank DESC, id) AS rn FROM x) SELECT id, used::BIGINT AS used FROM y, b WHERE used <= most OR rn = 1"""


@query("repo_summary", _SUMMARY)
def _(spark, d):
    """The central symbols of a summary of 1,000 tokens."""
    s, e = p.part_symbols(spark, d), p.call_edges(spark, d, bound=True)
    ranks = materialize(_ranks(spark, d).select("node", F.round("rank", 8).alias("rank")), "ranks")
    names = [r["language"] for r in s.select("language").distinct().collect()]
    return summary.central_symbols(s, e, ranks, budget.summary_budget(1000, names)).select("id", "used")


@query("repo_map", f"""WITH m AS ({_pagerank_sql(10, True)}), x AS (SELECT id, rank, p_type AS file, p_size AS line, p_name || ' ' || p_type AS sig FROM m JOIN part ON p_partkey::VARCHAR = id ORDER BY rank DESC, file, line, id LIMIT 2000),
y AS (SELECT *, (strlen(sig) + 8) // 4 + 1 + CASE WHEN row_number() OVER (PARTITION BY file ORDER BY rank DESC, file, line, id) = 1 THEN (strlen(file) + 2) // 4 + 1 ELSE 0 END AS cost FROM x),
z AS (SELECT *, sum(cost) OVER (ORDER BY rank DESC, file, line, id ROWS UNBOUNDED PRECEDING) AS used FROM y)
SELECT id, file, round(rank / (SELECT max(rank) FROM m), 4) AS relative FROM z WHERE used <= 4000""")
def _(spark, d):
    ranks = _ranks(spark, d, ["1", "2", "3"]).select(F.col("node").alias("id"), F.round("rank", 8).alias("rank"))
    ranks = materialize(ranks, "ranks")
    top = ranks.agg(F.max("rank").alias("top"))
    rows = ranks.join(p.part_symbols(spark, d), "id").crossJoin(F.broadcast(top))  # one row
    kept = budget.grouped(rows, "file", [F.desc("rank"), "file", "line_start", "id"], budget.map_cost(), budget.map_header(), DEFAULT_BUDGET, budget.LEAST_MAP_COST)
    return kept.select("id", "file", F.round(F.col("rank") / F.col("top"), 4).alias("relative"))


# ---------------------------------------------------------------- text

_STOP = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")"


def _stem_sql(t: str) -> str:
    """The rule in SQL: a suffix goes if over two bytes stay, ies and ied become y; then all e's at the end of what has over three bytes."""
    cases = " ".join(f"WHEN suffix({t}, '{s}') AND strlen({t}) > {len(s) + 2} THEN left({t}, length({t}) - {len(s)})" + (" || 'y'" if s in ("ies", "ied") else "") for s in text.SUFFIXES)
    c = f"(CASE {cases} ELSE {t} END)"
    return f"(CASE WHEN strlen({c}) > 3 THEN rtrim({c}, 'e') ELSE {c} END)"


def _words_sql(x: str) -> str:
    for pattern in (r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{Ll})(\p{Lu})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        x = f"regexp_replace({x}, '{pattern}', '\\1 \\2', 'g')"
    x = f"string_split(lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    return f"list_filter({x}, lambda w: w <> '' AND (strlen(w) > 1 OR regexp_matches(w, '^[0-9]$')) AND w NOT IN {_STOP})"


@query("tokenize", f"SELECT p_partkey::VARCHAR AS id, array_to_string({_words_sql('p_name || p_brand || p_type')}, ' ') AS words FROM part")
def _(spark, d):
    return p.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.array_join(text.words(F.concat("p_name", "p_brand", "p_type")), " ").alias("words"))


_DOC_TERMS = f"w AS (SELECT doc_id AS id, unnest({_words_sql('coalesce(text, chr(32))')}) AS t FROM documents), k AS (SELECT id, {_stem_sql('t')} AS term FROM w), tf AS (SELECT id, term, count(*)::DOUBLE AS wtf FROM k GROUP BY id, term)"


def _doc_index(spark, d):
    return search.postings(p.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), {"text": 1.0})


def _text_index(spark, d):
    return search.TextIndex(p.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), {"text": 1.0})


@query("stem_terms", f"SELECT DISTINCT t AS word, {_stem_sql('t')} AS term FROM (SELECT unnest({_words_sql('text')}) AS t FROM benchmark)")
def _(spark, d):
    return text.stemmed(p.table(spark, d, "benchmark").select(F.explode(text.words(F.col("text"))).alias("word")).distinct(), "word", "term")


@query("term_df", f"WITH {_DOC_TERMS} SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term")
def _(spark, d):
    return search.document_frequency(_doc_index(spark, d))


@query("idf", f"WITH {_DOC_TERMS}, n AS (SELECT count(DISTINCT id) AS n FROM tf) SELECT term, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM tf, n GROUP BY term")
def _(spark, d):
    index = _text_index(spark, d)
    return search.document_frequency(index.postings).select("term", F.round(search.idf(F.col("df"), F.lit(index.n)), 6).alias("idf"))


#: Query words that the invented English of the documents has, with one that has synonyms.
_QUERY = "with the thing find"


def _bm25_sql(synonyms: bool) -> str:
    syn = " UNION ALL SELECT unnest(['search', 'find', 'query', 'lookup', 'match']), 0.5, 0" if synonyms else ""
    return f"""{_DOC_TERMS}, q0 AS (SELECT unnest({_words_sql(f"'{_QUERY}'")}) AS t, 1.0 AS qw, 1 AS o{syn}), q AS (SELECT {_stem_sql('t')} AS term, max(qw)::DOUBLE AS qw, max(o) AS o FROM q0 GROUP BY 1),
l AS (SELECT id, sum(wtf) AS len FROM tf GROUP BY id), st AS (SELECT count(*) AS n, avg(len) AS al FROM l), f AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
h AS (SELECT id, sum(qw * ln((n - df + 0.5) / (df + 0.5) + 1) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * len / al))) * (1 + 0.5 * sum(o) / (SELECT sum(o) FROM q)) AS score FROM tf JOIN q USING (term) JOIN f USING (term) JOIN l USING (id), st GROUP BY id)"""


def _hits(spark, d, synonyms):
    return search.bm25(_text_index(spark, d), search.query_terms(spark, _QUERY, text.SYNONYMS if synonyms else [["-"]]))


@query("bm25f_topk", f"WITH {_bm25_sql(False)} SELECT id, round(score, 4) AS score FROM h ORDER BY h.score DESC, id LIMIT 20")
def _(spark, d):
    return _hits(spark, d, False).orderBy(F.desc("score"), "id").limit(20).select("id", F.round("score", 4).alias("score"))


@query("bm25_synonyms", f"WITH {_bm25_sql(True)} SELECT id, round(score, 4) AS score FROM h")
def _(spark, d):
    return _hits(spark, d, True).select("id", F.round("score", 4).alias("score"))


_RRF = f"""{_bm25_sql(True)}, z AS (SELECT h.id, row_number() OVER (ORDER BY round(score, 6) DESC, h.id) - 1 AS lex, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, h.id) - 1 AS cent FROM h JOIN documents ON doc_id = h.id),
y AS (SELECT *, 1.0::DOUBLE / (61 + lex) + 0.35::DOUBLE / (61 + cent) AS fused FROM z)"""


def _fused(spark, d):
    central = p.table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.col("n_chars").alias("rank"))
    return search.fuse(_hits(spark, d, True), central)


@query("rrf_find", f"WITH {_RRF} SELECT id, lex::BIGINT AS lex, cent::BIGINT AS cent, round(fused, 8) AS fused FROM y")
def _(spark, d):
    return _fused(spark, d).select("id", "lex", "cent", F.round("fused", 8).alias("fused"))


@query("find_filtered", f"WITH {_RRF} SELECT id, round(fused / (SELECT max(fused) FROM y), 3) AS relative FROM y JOIN documents ON doc_id = id WHERE lower(lang) = 'en'")
def _(spark, d):
    docs = p.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), "n_chars")
    return search.find(docs, None, _text_index(spark, d), docs.select(F.col("id").alias("node"), F.col("n_chars").alias("rank")), f"lang:EN {_QUERY}").select("id", "relative")


# ---------------------------------------------------------------- budgets

_COST = "(strlen(p_name) + strlen(p_name || ' ' || p_type) + strlen(p_type) + strlen(p_brand) + 10 + 64) // 4 + 1"


@query("budget_prefix", f"SELECT id, used::BIGINT AS used FROM (SELECT p_partkey::VARCHAR AS id, sum({_COST}) OVER (ORDER BY p_name, p_partkey::VARCHAR ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (ORDER BY p_name, p_partkey::VARCHAR) AS rn FROM part) WHERE used <= 4000 OR rn = 1")
def _(spark, d):
    return budget.prefix(p.part_symbols(spark, d), ["name", "id"], budget.view_cost(), DEFAULT_BUDGET).select("id", "used")


@query("budget_grouped", f"SELECT id, used::BIGINT AS used FROM (SELECT id, sum(c + h) OVER (ORDER BY p_name, id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (ORDER BY p_name, id) AS rn FROM (SELECT p_partkey::VARCHAR AS id, p_name, {_COST} AS c, CASE WHEN row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey::VARCHAR) = 1 THEN strlen(p_type) // 4 + 1 ELSE 0 END AS h FROM part)) WHERE used <= 2000 OR rn = 1")
def _(spark, d):
    return budget.grouped(p.part_symbols(spark, d), "file", ["name", "id"], budget.view_cost(), budget.tokens_of(F.octet_length("file")), 2000).select("id", "used")


@query("budget_sectional", f"SELECT id, section, used::BIGINT AS used FROM (SELECT p_partkey::VARCHAR AS id, (p_partkey % 3)::INT AS section, 100 + sum({_COST}) OVER (ORDER BY p_partkey % 3, p_name, p_partkey::VARCHAR ROWS UNBOUNDED PRECEDING) AS used FROM part) WHERE used <= 3000")
def _(spark, d):
    rows = p.part_symbols(spark, d).withColumn("section", (F.col("id").cast("long") % 3).cast("int"))
    return budget.sectional(rows, "section", ["name", "id"], budget.view_cost(), 3000, header=100).select("id", "section", "used")


# ---------------------------------------------------------------- diffs, ranges, snapshots

_DIFF = """diff --git a/one.py b/one.py
--- a/one.py
+++ b/one.py
@@ -3 +3,2 @@ def f():
-old
+new
+more
@@ -20,2 +21,0 @@
-gone
-gone
@@ -30,4 +29,5 @@
 same
+in
 same
 same
+end
--- /dev/null
+++ b/new.py
@@ -0,0 +1,2 @@
+a
+b
--- a/old.py
+++ /dev/null
@@ -1 +0,0 @@
-x"""


@query("diff_line_ranges", "SELECT * FROM (VALUES ('one.py', 3, 4), ('one.py', 21, 21), ('one.py', 30, 30), ('one.py', 33, 33), ('new.py', 1, 2)) t(file, line_lo, line_hi)")
def _(spark, d):
    return impact.diff_ranges(files.diff_lines(spark, _DIFF)).select("file", "line_lo", "line_hi")


@query("range_islands", "SELECT min(o_orderkey)::INT AS line_lo, max(o_orderkey)::INT AS line_hi FROM (SELECT o_orderkey, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS g FROM orders WHERE o_orderstatus = 'F') GROUP BY g")
def _(spark, d):
    """D2 over keys."""
    return impact.merge_points(p.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("int").alias("line")))


_SPANS = """e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t, event_id, event_type FROM events), {h}"""


def _session_sql(hours: int, name: str) -> str:
    return f"{name} AS (SELECT user_id, s, min(t) AS lo, max(t) AS hi, count(*)::BIGINT AS events FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= {hours * 3600} THEN 0 ELSE 1 END AS n FROM e)) GROUP BY user_id, s)"


@query("debounce_sessions", f"WITH {_SPANS.format(h=_session_sql(12, 'x'))} SELECT user_id, lo, events FROM x")
def _(spark, d):
    """Gaps are taken between whole seconds, as in the SQL: 12 hours and part of a second may be no gap."""
    events = p.table(spark, d, "events")
    events = events.select("user_id", F.timestamp_seconds(p.whole_seconds(events, "ts")).alias("ts"))
    return watch.bursts(events, "user_id", "ts", "12 hours").select("user_id", F.unix_seconds("start").alias("lo"), "events")


_NEST = f"""{_SPANS.format(h=_session_sql(48, 'x') + ', ' + _session_sql(12, 'y'))}, z AS (SELECT 'a' || s || '_' || user_id AS id, user_id, lo, hi FROM x UNION ALL SELECT 'b' || s || '_' || user_id, user_id, lo, hi FROM y),
r AS (SELECT DISTINCT user_id, t FROM e WHERE event_type = 'error'), hit AS (SELECT id, z.user_id, t, lo, hi FROM z JOIN r ON r.user_id = z.user_id AND lo <= t AND hi >= t),
ch AS (SELECT DISTINCT id FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit g WHERE g.user_id = h.user_id AND g.t = h.t AND h.lo <= g.lo AND h.hi >= g.hi AND h.hi - h.lo > g.hi - g.lo))"""


def _nested(spark, d):
    def spans(hours, mark):
        s = p.sessions(spark, d, hours)
        return s.select(F.concat(F.lit(mark), "session", F.lit("_"), "user_id").alias("id"), F.lit("function").alias("kind"), F.col("user_id").cast("string").alias("file"), F.col("lo").alias("line_start"), F.col("hi").alias("line_end"), F.col("lo").alias("byte_start"), F.col("hi").alias("byte_end"))

    errors = p.table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").cast("string").alias("file"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("line_lo")).distinct().withColumn("line_hi", F.col("line_lo"))
    return spans(48, "a").unionByName(spans(12, "b")), errors


@query("changed_innermost", f"WITH {_NEST} SELECT id FROM ch")
def _(spark, d):
    return impact.changed_symbols(*_nested(spark, d))


_IMPACT = f"""{_G}, root AS (SELECT p_partkey AS k FROM part WHERE p_size = 1 AND p_type = (SELECT min(p_type) FROM part)), r1 AS (SELECT DISTINCT src AS k FROM g WHERE dst IN (SELECT k FROM root) AND src NOT IN (SELECT k FROM root)),
r2 AS (SELECT DISTINCT src AS k FROM g WHERE dst IN (SELECT k FROM r1) AND src NOT IN (SELECT k FROM root) AND src NOT IN (SELECT k FROM r1)), a AS (SELECT k, 0 AS depth FROM root UNION ALL SELECT k, 1 FROM r1 UNION ALL SELECT k, 2 FROM r2),
met AS (SELECT k, 0 AS section, 0 AS depth FROM root UNION ALL SELECT k, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN 1 ELSE 2 END, depth FROM a JOIN part ON p_partkey = k WHERE depth > 0 OR p_brand = (SELECT min(p_brand) FROM part))"""


def _impact(spark, d):
    s = p.part_symbols(spark, d)
    low = s.agg(F.min("file").alias("f"), F.min("owner").alias("o")).first()
    s = s.withColumn("line_end", F.col("line_start")).withColumn("name", F.when(F.col("owner") == low["o"], "test_it").otherwise(F.col("name"))).withColumn("kind", F.lit("function"))
    ranges = spark.createDataFrame([(low["f"], 1, 1)], "file string, line_lo int, line_hi int")
    e = p.part_edges(spark, d).select(F.lit("calls").alias("kind"), F.col("src").alias("from_id"), F.col("dst").alias("to_id"))
    s = s.withColumn("byte_start", F.lit(0)).withColumn("byte_end", F.lit(1))
    return s, ranges, impact.diff_impact(s, e, ranges, max_depth=2)


@query("impact_split", f"WITH {_IMPACT} SELECT k::VARCHAR AS id, section, depth FROM met")
def _(spark, d):
    return _impact(spark, d)[2]


@query("impact_counts", f"""WITH {_IMPACT} SELECT 1::BIGINT AS files_changed, count(*) FILTER (WHERE section = 0)::BIGINT AS symbols_changed, count(*) FILTER (WHERE section = 2)::BIGINT AS symbols_impacted, count(*) FILTER (WHERE section = 1)::BIGINT AS tests_impacted,
  count(DISTINCT p_type) FILTER (WHERE section = 2)::BIGINT AS files_impacted FROM met JOIN part ON p_partkey = k""")
def _(spark, d):
    s, ranges, met = _impact(spark, d)
    return impact.impact_counts(met, s, ranges)


_V = "old AS (SELECT o_orderkey AS k, md5(o_orderstatus) AS h FROM orders WHERE o_orderkey % 7 <> 0), new AS (SELECT o_orderkey AS k, md5(CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END) AS h FROM orders WHERE o_orderkey % 11 <> 0), st AS (SELECT coalesce(o.k, n.k)::VARCHAR AS path, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'modified' END AS status FROM old o FULL JOIN new n ON o.k = n.k)"


def _delta(spark, d):
    orders = p.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    old = orders.where("k % 7 <> 0").select(F.col("k").cast("string").alias("path"), F.md5("o_orderstatus").alias("content_hash"))
    new = orders.where("k % 11 <> 0").select(F.col("k").cast("string").alias("path"), F.md5(F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("content_hash"))
    return fresh.delta(old, new)


@query("snapshot_delta", f"WITH {_V} SELECT * FROM st")
def _(spark, d):
    return _delta(spark, d)


@query("stale_counts", f"WITH {_V} SELECT count(*) FILTER (WHERE status = 'modified')::BIGINT AS modified, count(*) FILTER (WHERE status = 'added')::BIGINT AS added, count(*) FILTER (WHERE status = 'removed')::BIGINT AS removed, count(*) FILTER (WHERE status <> 'unchanged') > 0 AS stale FROM st")
def _(spark, d):
    return fresh.stale_counts(_delta(spark, d))


@query("patch_equals_rebuild", f"WITH {_BIND} SELECT b.edge_id, x.to_id FROM b LEFT JOIN bound x USING (edge_id)")
def _(spark, d):
    """I4: take a file out and put it in again; the edges are those of a rebuild."""
    s, e = p.part_symbols(spark, d), p.call_edges(spark, d)
    done = materialize(resolve.resolve(e, s), "edges")
    touched = s.agg(F.min("file").alias("path"))
    mine = s.join(touched.withColumnRenamed("path", "file"), "file", "left_semi")
    theirs = e.join(mine.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return fresh.patch(s, done, touched, mine.select(s.columns), theirs.select(done.columns))[1].select("edge_id", "to_id")


# ---------------------------------------------------------------- sources, extraction, imports

#: Every supplier's file and that of the next one, which it imports.
_SUP = """s AS (SELECT s_suppkey AS k, s_nationkey AS n, (s_suppkey + 1) % (SELECT count(*) FROM supplier) AS k2 FROM supplier),
f AS (SELECT s.k, s.k2, 'pkg' || s.n || '/sup' || s.k || '.py' AS file, 'pkg' || t.n || '/sup' || t.k || '.py' AS file2, t.n AS n2 FROM s JOIN s t ON t.k = s.k2)"""


def _values(rows, names: str) -> str:
    said = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows) + f") t({names})"


@query("extract_symbols", f"""WITH {_SUP} SELECT file, name, kind, owner, lo::INT AS line_start, hi::INT AS line_end, doc FROM f, LATERAL (VALUES ('sup' || k, 'module', NULL, 1, 17, 'Supplier ' || k || '.'), ('Sup' || k, 'class', NULL, 5, 12, 'Orders of supplier ' || k || '.'),
  ('total', 'method', 'Sup' || k, 8, 9, NULL), ('part', 'method', 'Sup' || k, 11, 12, NULL), ('run' || k, 'function', NULL, 15, 17, NULL)) v(name, kind, owner, lo, hi, doc)""")
def _(spark, d):
    """X4-X12, X20-X22, X24."""
    symbols, _ = extract.extract(p.supplier_sources(spark, d))
    return symbols.select("file", "name", "kind", "owner", "line_start", "line_end", "doc")


@query("extract_sites", f"""WITH {_SUP} SELECT file, kind, name AS to_name, q AS qualifier, ln::INT AS line FROM f, LATERAL (VALUES ('imports', 'pkg' || n2 || '.sup' || k2, NULL, 2), ('calls', 'part', 'self', 9), ('calls', 'Sup' || k2, NULL, 16), ('calls', 'total', 'Sup' || k2, 17),
  ('contains', 'Sup' || k, NULL, 5), ('contains', 'total', NULL, 8), ('contains', 'part', NULL, 11), ('contains', 'run' || k, NULL, 15)) v(kind, name, q, ln)""")
def _(spark, d):
    """Sites with their receivers, a variable's by the type it was made with."""
    symbols, edges = extract.extract(p.supplier_sources(spark, d))
    return edges.join(symbols.select(F.col("id").alias("from_id"), "file"), "from_id").select("file", "kind", "to_name", "qualifier", "line")


@query("import_bindings", f"WITH {_SUP} SELECT file, file2 AS to_file, 0 AS alternatives FROM f")
def _(spark, d):
    """Dotted imports of modules."""
    symbols, edges = extract.extract(p.supplier_sources(spark, d))
    bound = imports.bind(edges, symbols).join(edges.select("edge_id", "from_id"), "edge_id")
    ends = symbols.select(F.col("id"), "file")
    return bound.join(ends.withColumnsRenamed({"id": "from_id"}), "from_id").join(ends.withColumnsRenamed({"id": "to_id", "file": "to_file"}), "to_id").select("file", "to_file", "alternatives")


@query("source_graph", f"""WITH {_SUP} SELECT file, name AS to_name, ln::INT AS line, CASE WHEN own THEN file ELSE file2 END AS to_file, owner AS to_owner FROM f, LATERAL (VALUES ('part', 9, true, 'Sup' || k), ('Sup' || k2, 16, false, NULL), ('total', 17, false, 'Sup' || k2)) v(name, ln, own, owner)""")
def _(spark, d):
    """From texts to bound calls."""
    g = CodeGraph.of_sources(p.supplier_sources(spark, d))
    ends = g.symbols.select("id", "file", "owner")
    bound = g.edges.where("kind = 'calls'").join(ends.select(F.col("id").alias("from_id"), "file"), "from_id").join(ends.select(F.col("id").alias("to_id"), F.col("file").alias("to_file"), F.col("owner").alias("to_owner")), "to_id")
    return bound.select("file", "to_name", "line", "to_file", "to_owner")


def _corpus(spark):
    return spark.createDataFrame([(f, lang, t) for f, (lang, t) in corpus.SOURCES.items()], "path string, language string, content string").coalesce(1)


@query("corpus_calls", _values([(*k, *(v.split("@") if v else (None, None))) for k, v in corpus.EXPECTED.items()], "file, line, callee, target, to_file"))
def _(spark, d):
    """M1's sites in ten languages: what calls of the small corpus bind to."""
    g = CodeGraph.of_sources(_corpus(spark))
    wanted = spark.createDataFrame(list(corpus.EXPECTED), "file string, line int, callee string")
    sites = g.edges.where("kind = 'calls'").join(g.symbols.select(F.col("id").alias("from_id"), "file"), "from_id").select("file", "line", F.col("to_name").alias("callee"), "to_id")
    ends = g.symbols.select(F.col("id").alias("to_id"), paths.qualified_name(F.col("owner"), F.col("name")).alias("target"), F.col("file").alias("to_file"))
    return wanted.join(sites, ["file", "line", "callee"], "left").join(ends, "to_id", "left").select("file", "line", "callee", "target", "to_file")


@query("corpus_imports", _values([(*k, v) for k, v in corpus.IMPORTS.items()], "file, import_text, to_file"))
def _(spark, d):
    """R9-R14 in eight languages."""
    g = CodeGraph.of_sources(_corpus(spark))
    wanted = spark.createDataFrame(list(corpus.IMPORTS), "from_file string, import_text string")
    return traverse.dependencies(g.edges, g.symbols).join(wanted, ["from_file", "import_text"]).select(F.col("from_file").alias("file"), "import_text", "to_file")


@query("generated_corpora", """SELECT 'python' AS language, 'f' || i || '_' || k AS name, 'f' || ((i + 1) % 40) || '_' || k AS calls FROM range(40) a(i), range(5) b(k)
UNION ALL SELECT 'rust', 'f' || i || '_' || k, 'f' || ((i + j) % 40) || '_' || ((k + j) % 5) FROM range(40) a(i), range(5) b(k), range(1, 10) c(j)""")
def _(spark, d):
    """Both generated corpora and the calls found in them."""
    both = files.generated(spark, 40, 5).unionByName(files.generated_dense(spark, 40, 5))
    symbols, edges = extract.extract(both)
    return edges.where("kind = 'calls'").join(symbols.select(F.col("id").alias("from_id"), "language", "name"), "from_id").select("language", "name", F.col("to_name").alias("calls"))


@query("store_update", f"""WITH b AS (SELECT p_type AS file, count(*) AS n FROM part GROUP BY 1) SELECT file, (CASE WHEN file = (SELECT max(p_type) FROM part) THEN 1 ELSE n END)::BIGINT AS symbols FROM b WHERE file <> (SELECT min(p_type) FROM part)""")
def _(spark, d):
    """Write all files, then replace one and remove another; what the store then holds."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    s, e = p.part_symbols(spark, d), p.call_edges(spark, d)
    listed = s.select(F.col("file").alias("path")).distinct().select("path", F.lit("part").alias("language"), F.md5("path").alias("content_hash"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(0).cast("long").alias("size"))
    columns = [c.split()[0] for c in SYMBOLS.split(", ")]
    store.upsert({"files": listed, "symbols": s.select(columns), "edges": e})
    ends = s.agg(F.min("file").alias("low"), F.max("file").alias("high")).first()
    one = s.where(F.col("file") == ends["high"]).orderBy(F.col("id").cast("long")).limit(1)
    new = {"files": listed.where(F.col("path") == ends["high"]), "symbols": one.select(columns), "edges": e.join(one.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(e.columns)}
    store.upsert(new, spark.createDataFrame([(ends["low"],)], "path string"))
    held = store.read("symbols")
    return store.read("files").join(held.withColumnRenamed("file", "path"), "path").groupBy(F.col("path").alias("file")).agg(F.count("*").alias("symbols"))


@query("stat_delta", """WITH k AS (SELECT o_orderkey AS k, o_orderdate AS t FROM orders), st AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'added' WHEN k % 11 = 0 THEN 'removed' WHEN t >= TIMESTAMP '1995-06-01' - INTERVAL 50 MILLISECONDS THEN 'modified' ELSE 'unchanged' END AS status FROM k WHERE NOT (k % 7 = 0 AND k % 11 = 0)) SELECT k::VARCHAR AS path, status FROM st""")
def _(spark, d):
    """What has changed by the files' status alone; orders as files, their dates as times of change."""
    orders = p.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").cast("timestamp").alias("mtime"))
    return fresh.stat_delta(orders.where("k % 7 <> 0"), orders.where("k % 11 <> 0"), "1995-06-01")


@query("needs_reading", """SELECT o_orderkey::VARCHAR AS path FROM orders WHERE o_orderkey % 7 = 0 OR o_orderdate >= TIMESTAMP '1995-06-01' - INTERVAL 50 MILLISECONDS""")
def _(spark, d):
    """Files that are unknown, or touched since the last run."""
    orders = p.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").cast("timestamp").alias("mtime"))
    return fresh.needs_reading(orders.select("path", "mtime"), orders.where("k % 7 <> 0"), "1995-06-01").select("path")


_PATHS = {"tests/a.rs": 1, "test/a.py": 1, "src/tests/a.rs": 1, "src/test/a.rs": 1, "web/__tests__/a.ts": 1, "spec/a.rb": 1, "lib/spec/a.rb": 1, "pkg/test_a.py": 1, "pkg/a_test.go": 1, "a_test.py": 1, "a_test.rs": 1, "web/a.test.ts": 1, "web/a.spec.js": 1, "a_spec.rb": 1, "a_test.rb": 1, "ATest.java": 1, "ATests.java": 1, "ATest.cs": 1, "ATests.cs": 1, "a_test.c": 1, "a_test.cc": 1, "a_test.cpp": 1, "a_unittest.cc": 1, "src/latest.rs": 0, "contest/a.py": 0, "attest.java": 0, "src/testing/a.rs": 0, "a_test.ts": 0, "specs/a.rb": 0, "a_tests.py": 0}


@query("test_paths", _values(list(_PATHS.items()), "file, is_test"))
def _(spark, d):
    """Paths of tests, and paths that look like them."""
    rows = spark.createDataFrame([(x,) for x in _PATHS], "file string")
    return rows.select("file", impact.is_test_path(F.col("file")).cast("int").alias("is_test"))


@query("budget_dependencies", f"""WITH {_N}, e AS (SELECT a.n_name AS from_file, dst::VARCHAR AS import_text FROM n JOIN nation a ON a.n_nationkey = src), u AS (SELECT *, sum((strlen(from_file) + strlen(import_text) + 32) // 4 + 1) OVER (ORDER BY from_file, import_text ROWS UNBOUNDED PRECEDING) AS used FROM e)
SELECT from_file, import_text, used::BIGINT AS used FROM u WHERE used <= 300""")
def _(spark, d):
    """B4."""
    nation = p.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("src"), F.col("n_name").alias("from_file"))
    e = p.nation_edges(spark, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("import_text")).join(nation, "src")
    return budget.prefix(e, ["from_file", "import_text"], budget.dependency_cost("from_file", "import_text"), 300, 32 // 4 + 1).select("from_file", "import_text", "used")


@query("watch_stream", "SELECT user_id::VARCHAR AS path, floor(epoch(max(ts)))::BIGINT AS at FROM events GROUP BY 1")
def _(spark, d):
    """Events as a file stream; every batch brings each path's last event into a table."""
    folder = f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}"
    source = p.table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    watch.watch(stream, lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/table/batch={number}"), f"{folder}/state").awaitTermination()
    return spark.read.schema("path string, ts timestamp").parquet(f"{folder}/table").groupBy("path").agg(F.unix_seconds(F.max("ts")).alias("at"))


# ---------------------------------------------------------------- metrics


@query("eval_rollup", """WITH o AS (SELECT source, CASE WHEN quality = 1 AND toxic = 1 THEN 'tp' WHEN toxic = 1 THEN 'fp' WHEN quality = 1 THEN 'fn' ELSE 'tn' END AS x FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, count(*) FILTER (WHERE x = 'tp')::BIGINT AS tp, count(*) FILTER (WHERE x = 'fp')::BIGINT AS fp, count(*) FILTER (WHERE x = 'fn')::BIGINT AS fn, count(*) FILTER (WHERE x = 'tn')::BIGINT AS tn FROM o GROUP BY ROLLUP (source))
SELECT source, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 1), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 1), 6) AS recall, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 1), 6) AS accuracy FROM c""")
def _(spark, d):
    rows = p.table(spark, d, "labels").join(p.table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("source", "quality", "toxic", F.col("doc_id").cast("string").alias("file"), F.lit(0).alias("line"), F.lit("x").alias("callee"))
    outcomes = evaluation.outcomes(rows.withColumn("expected", F.when(F.col("quality") == 1, "t")), rows.where("toxic = 1").select("file", "line", "callee", F.lit("t").alias("target")))
    return evaluation.confusion(outcomes, "source").select("source", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy")])


@query("retrieval_mrr", "WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type FROM events), b AS (SELECT user_id, min(k) FILTER (WHERE event_type = 'purchase') AS k FROM r GROUP BY 1) SELECT round(avg(coalesce(1.0 / k, 0)), 6) AS mrr, round(avg(CASE WHEN k <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN k <= 5 THEN 1.0 ELSE 0 END), 6) AS r5 FROM b")
def _(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = p.table(spark, d, "events").select(F.col("user_id").alias("query"), F.when(F.col("event_type") == "purchase", F.row_number().over(order)).alias("rank"))
    return evaluation.retrieval(rows).select(*[F.round(c, 6).alias(c) for c in ("mrr", "r1", "r5")])


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
