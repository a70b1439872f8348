"""The registered queries: operators of the engine over log lines derived from ``events``, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import correct, masking, params
from ..functions import tokens as T
from ..operators import extract, group, match, merge, metrics, sample, similarity, split
from ..operators.distinct import on_distinct
from ..sources import config, logs
from ..streaming.online import online
from .pipeline import mine, prepare
from .state import settle

#: Lines whose templates are known by construction; the same text is valid in Spark and DuckDB.
CONTENT = """CASE event_id % 4
  WHEN 0 THEN concat('user ', user_id, ' action ', event_type, ' took ', event_id % 97, ' ms')
  WHEN 1 THEN concat('Received block blk_', event_id, ' of size ', user_id, ' from 10.0.', user_id % 7, '.', event_id % 5)
  WHEN 2 THEN concat('Connection closed by 10.1.0.', user_id % 9, ' [preauth]')
  ELSE concat('session ', CASE WHEN event_id % 3 = 0 THEN 'opened' ELSE 'closed' END, ' for user ', event_type) END"""
LEVEL = "CASE WHEN event_id % 10 = 0 THEN 'WARN' ELSE 'INFO' END"
TRUTH = """CASE event_id % 4 WHEN 0 THEN 'user <*> action <*> took <*> ms' WHEN 1 THEN 'Received block <*> of size <*> from <*>'
  WHEN 2 THEN 'Connection closed by <*> [preauth]' ELSE concat('session ', CASE WHEN event_id % 3 = 0 THEN 'opened' ELSE 'closed' END, ' for user <*>') END"""

_LINES = f"lines AS (SELECT event_id AS log_index, event_type AS component, {LEVEL} AS level, {CONTENT} AS content, {TRUTH} AS truth, event_id, user_id FROM events)"
_TOKENS = "tok AS (SELECT *, string_split(content, ' ') AS t, len(string_split(content, ' '))::BIGINT AS n FROM lines)"
_WITH = f"WITH {_LINES}, {_TOKENS}"
_POS = "pos AS (SELECT n, p.pos - 1 AS pos, t[p.pos] AS tok, count(*) AS c FROM tok, LATERAL (SELECT unnest(range(1, n + 1)) AS pos) p GROUP BY ALL)"
_TEMPLATES = """tpl AS (SELECT n, list(CASE WHEN k = 1 THEN tok ELSE '<*>' END ORDER BY pos) AS tt FROM (SELECT n, pos, count(*) AS k, min(tok) AS tok FROM pos GROUP BY n, pos) GROUP BY n)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS log_index", "event_type AS component", f"{LEVEL} AS level", f"{CONTENT} AS content", f"{TRUTH} AS truth", "event_id", "user_id")


def tokened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their words; n is the number of words, or 1 line each where a weight is asked for."""
    return lines(spark, sf_dir).withColumn("tokens", T.words(F.col("content")))


def by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct contents with counts and their first line, keyed by n_tokens."""
    t = tokened(spark, sf_dir)
    return t.groupBy("content").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.min("log_index").alias("first_index")).withColumn("n_tokens", F.size("tokens").cast("long"))


@query(f"WITH {_LINES} SELECT log_index, regexp_replace(content, '\\b[0-9]+\\b', '<NUM>', 'g') AS masked FROM lines")
def mask_numbers(spark, sf_dir):
    rule = masking.MaskRule(r"\b\d+\b", "NUM")
    return lines(spark, sf_dir).select("log_index", masking.Masker([rule]).mask(F.col("content")).alias("masked"))


@query(f"WITH {_LINES} SELECT log_index, regexp_replace(regexp_replace(regexp_replace(content, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+', '<IP>', 'g'), 'blk_[0-9]+', '<BLOCK>', 'g'), '\\b[0-9]+\\b', '<NUM>', 'g') AS masked FROM lines")
def mask_chain(spark, sf_dir):
    rules = [masking.MaskRule(r"\d+\.\d+\.\d+\.\d+", "IP"), masking.MaskRule(r"blk_\d+", "BLOCK"), masking.MaskRule(r"\b\d+\b", "NUM")]
    return lines(spark, sf_dir).select("log_index", masking.Masker(rules).mask(F.col("content")).alias("masked"))


@query(f"WITH {_LINES} SELECT log_index, regexp_replace(regexp_replace(content, ' \\[preauth\\]', '', 'g'), '10\\.[0-9]+\\.[0-9]+\\.[0-9]+', '<*>', 'g') AS content FROM lines")
def dataset_preprocess(spark, sf_dir):
    return lines(spark, sf_dir).select("log_index", masking.preprocess(F.col("content"), [r" \[preauth\]"], [r"10\.\d+\.\d+\.\d+"]).alias("content"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations")
def squeeze_white_space(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", correct.squeeze(F.col("text")).alias("text"))


_CORRECTED = "regexp_replace(content, '(^| )[0-9]+(\\.[0-9]+)*', '\\1<*>', 'g')"


@query(f"WITH {_LINES} SELECT log_index, {_CORRECTED} AS content FROM lines")
def correct_contents(spark, sf_dir):
    return lines(spark, sf_dir).select("log_index", correct.correct_input(F.col("content")).alias("content"))


@query(f"WITH {_LINES} SELECT log_index, regexp_replace({_CORRECTED}, '\\[preauth\\]', '[ preauth ]', 'g') AS content, len(string_split(regexp_replace({_CORRECTED}, '\\[preauth\\]', '[ preauth ]', 'g'), ' '))::BIGINT AS n_tokens FROM lines")
def tokenise_contents(spark, sf_dir):
    made = {"t": lambda content: T.tokens(correct.correct_input(content))}
    return on_distinct(lines(spark, sf_dir).select("log_index", "content"), "content", made).select("log_index", F.array_join("t", " ").alias("content"), F.size("t").cast("long").alias("n_tokens"))


@query(f"WITH {_LINES} SELECT regexp_replace(regexp_replace({_CORRECTED}, '<\\*>( <\\*>)+', '<*>', 'g'), ' +', ' ', 'g') AS template, count(*) AS n FROM lines GROUP BY 1")
def correct_templates(spark, sf_dir):
    return lines(spark, sf_dir).select(correct.correct_final(F.col("content")).alias("template")).groupBy("template").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_WITH} SELECT n AS n_tokens, count(*) AS n_lines, count(DISTINCT content) AS n_contents FROM tok GROUP BY n")
def length_groups(spark, sf_dir):
    return tokened(spark, sf_dir).groupBy(F.size("tokens").cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("content").alias("n_contents"))


@query(f"{_WITH} SELECT concat(component, '¦¦¦', level, '¦¦¦', 'G ', n) AS static_key, count(*) AS n, min(log_index) AS first_index FROM tok GROUP BY 1")
def static_key_groups(spark, sf_dir):
    t = tokened(spark, sf_dir).withColumn("static_key", T.static_key(F.col("component"), F.col("level"), F.col("tokens")))
    return t.groupBy("static_key").agg(F.count(F.lit(1)).alias("n"), F.min("log_index").alias("first_index"))


@query(f"{_WITH} SELECT array_to_string(t[i + 1:i + 3], ' ') AS gram, count(*) AS n FROM (SELECT t, unnest(range(0, (n + 1) // 2)) AS i FROM tok) GROUP BY 1")
def ngram_windows(spark, sf_dir):
    return tokened(spark, sf_dir).select(F.explode(T.half_windows(F.col("tokens"))).alias("g")).groupBy(F.array_join("g", " ").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_WITH}, {_POS} SELECT n AS n_tokens, pos, tok, c FROM pos")
def token_frequency_by_position(spark, sf_dir):
    return split.token_counts(by_length(spark, sf_dir), ["n_tokens"]).select("n_tokens", F.col("pos").cast("long").alias("pos"), "tok", "c")


_STATS = """st AS (SELECT n, pos, sum(c) AS total, count(*) AS types, entropy_ AS h, bool_and(regexp_replace(tok, '[0-9]+(\\.[0-9]+)?', '0', 'g') = tok) AS stable
  FROM (SELECT *, -sum(c / tot * ln(c / tot)) OVER (PARTITION BY n, pos) AS entropy_ FROM (SELECT *, sum(c) OVER (PARTITION BY n, pos) AS tot FROM pos)) GROUP BY n, pos, entropy_),
w AS (SELECT n, pos, total, types, h, stable, CASE WHEN NOT stable THEN 1.0 ELSE round((CASE WHEN types > 1 THEN h / ln(types) ELSE 0 END) * least((types - 1) / 4.0, 1.0), 9) END AS weight FROM st)"""


@query(f"{_WITH}, {_POS}, {_STATS} SELECT n AS n_tokens, pos, types, round(abs(h), 6) AS entropy, round(abs(h) / ln(2), 6) AS bits FROM w")
def position_entropy(spark, sf_dir):
    stats = split.position_stats(split.token_counts(by_length(spark, sf_dir), ["n_tokens"]), ["n_tokens"])
    return stats.select("n_tokens", F.col("pos").cast("long").alias("pos"), "types", F.round(F.abs("entropy"), 6).alias("entropy"), F.round(F.abs("entropy") / F.log(F.lit(2.0)), 6).alias("bits"))


@query(f"{_WITH}, {_POS}, {_STATS} SELECT n AS n_tokens, pos, round(weight, 6) AS weight FROM w")
def position_weights(spark, sf_dir):
    stats = split.position_stats(split.token_counts(by_length(spark, sf_dir), ["n_tokens"]), ["n_tokens"])
    return stats.select("n_tokens", F.col("pos").cast("long").alias("pos"), F.round(split.position_weight(), 6).alias("weight"))


@query(
    f"{_WITH}, {_POS}, {_STATS}, "
    """ch AS (SELECT n, pos FROM (SELECT n, pos, weight, min(CASE WHEN weight > 0 THEN weight END) OVER (PARTITION BY n) AS least FROM w WHERE weight <= 0.25) WHERE weight = 0 OR weight = least),
pl AS (SELECT n, list(pos ORDER BY pos) AS ps FROM ch GROUP BY n)
SELECT tok.n AS n_tokens, coalesce(array_to_string(list_transform(ps, lambda p: t[p + 1]), ' '), '') AS branch, count(*) AS n_lines, count(DISTINCT content) AS n_contents FROM tok LEFT JOIN pl USING (n) GROUP BY 1, 2"""
)
def variance_split(spark, sf_dir):
    rows = split.variance_split(by_length(spark, sf_dir), ["n_tokens"])
    return rows.groupBy("n_tokens", F.array_join("branch", " ").alias("branch")).agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_contents"))


@query(f"{_WITH}, {_POS}, {_TEMPLATES} SELECT n AS n_tokens, array_to_string(tt, ' ') AS template FROM tpl")
def positionwise_templates(spark, sf_dir):
    return extract.positionwise_template(by_length(spark, sf_dir), ["n_tokens"])


@query(f"WITH {_LINES} SELECT content AS template, count(*) AS n_matched, min(log_index) AS first_index FROM lines GROUP BY 1")
def unique_line_templates(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(F.col("content").alias("template")).agg(F.count(F.lit(1)).alias("n_matched"), F.min("log_index").alias("first_index"))


@query(f"{_WITH} SELECT n_tokens, place, content FROM (SELECT n AS n_tokens, content, row_number() OVER (PARTITION BY n ORDER BY min(log_index)) AS place FROM tok GROUP BY n, content) WHERE place <= 5")
def first_samples(spark, sf_dir):
    return extract.first_samples(by_length(spark, sf_dir), ["n_tokens"]).withColumn("place", F.col("place").cast("long"))


def _known(spark, sf_dir):
    """Templates by length, with ids by length."""
    t = extract.positionwise_template(by_length(spark, sf_dir), ["n_tokens"])
    return t.select(F.col("n_tokens").alias("template_id"), "template")


_MATCHES = f"{_WITH}, {_POS}, {_TEMPLATES}, dist AS (SELECT DISTINCT content, t, n FROM tok), hit AS (SELECT d.content, p.n AS template_id FROM dist d JOIN tpl p ON d.n = p.n WHERE len(list_filter(range(1, d.n + 1), lambda i: p.tt[i] = '<*>' OR p.tt[i] = d.t[i])) = d.n AND list_contains(list_transform(p.tt, lambda x: x <> '<*>'), true))"
_HEADS = "key AS (SELECT content, n, t, [[t[1], t[2], t[3]], ['<*>', t[2], t[3]], [t[1], '<*>', t[3]], [t[1], t[2], '<*>'], ['<*>', t[2], '<*>']] AS ks, [[t[n-2], t[n-1], t[n]], ['<*>', t[n-1], t[n]], [t[n-2], '<*>', t[n]], [t[n-2], t[n-1], '<*>'], ['<*>', t[n-1], '<*>']] AS bs FROM dist), cand AS (SELECT content, p.n AS template_id, list_contains(ks, p.tt[1:3]) AS f, list_contains(bs, p.tt[-3:]) AS b FROM key, tpl p WHERE list_contains(ks, p.tt[1:3]) OR list_contains(bs, p.tt[-3:]))"


@query(f"{_MATCHES}, {_HEADS} SELECT content, template_id FROM (SELECT *, bool_or(f AND b) OVER (PARTITION BY content) AS best FROM cand) WHERE NOT best OR (f AND b)")
def candidate_templates(spark, sf_dir):
    return match.candidates(by_length(spark, sf_dir).select("content", "tokens"), settle(_known(spark, sf_dir)))


@query(f"{_MATCHES}, {_HEADS} SELECT h.content, h.template_id FROM hit h JOIN (SELECT content, template_id FROM (SELECT *, bool_or(f AND b) OVER (PARTITION BY content) AS best FROM cand) WHERE NOT best OR (f AND b)) c ON h.content = c.content AND h.template_id = c.template_id")
def match_templates(spark, sf_dir):
    return match.match_templates(by_length(spark, sf_dir).select("content", "tokens"), settle(_known(spark, sf_dir)))


@query(f"{_WITH} SELECT n AS n_tokens, count(DISTINCT content) AS n_contents FROM tok WHERE n <> 7 GROUP BY n")
def unmatched_contents(spark, sf_dir):
    rows = by_length(spark, sf_dir)
    left = match.unmatched(rows, rows.filter("n_tokens = 7").select("content"))
    return left.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_contents"))


@query(f"{_WITH}, {_POS}, {_TEMPLATES} SELECT log_index, n AS template_id, 1.0::DOUBLE AS similarity FROM tok JOIN tpl USING (n)")
def online_match(spark, sf_dir):
    from ..streaming.online import match_online

    return match_online(lines(spark, sf_dir).select("log_index", "content"), settle(_known(spark, sf_dir)))


_SIMILAR = "s AS (SELECT p_partkey AS id, list_distinct(string_split(concat(p_name, ' ', p_brand, ' ', p_type, ' ', p_size), ' ')) AS t FROM part)"


def _part_tokens(spark, sf_dir):
    """As in the SQL, where concat passes over nulls."""
    words = ", ' ', ".join(f"coalesce(cast({c} AS string), '')" for c in ("p_name", "p_brand", "p_type", "p_size"))
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"split(concat({words}), ' ') AS tokens")


@query(f"WITH {_SIMILAR} SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))), 9) AS similarity FROM s x JOIN s y ON x.id < y.id WHERE len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) >= 0.8")
def similar_pairs(spark, sf_dir):
    return similarity.similar_pairs(_part_tokens(spark, sf_dir), 0.8).withColumn("similarity", F.round("similarity", 9))


@query(f"{_WITH}, {_POS}, {_TEMPLATES} SELECT log_index, round(len(list_filter(range(1, tok.n + 1), lambda i: tt[i] = t[i])) / tok.n, 9) AS similarity, len(list_filter(tt, lambda x: x = '<*>'))::BIGINT AS n_wildcards FROM tok JOIN tpl USING (n)")
def sequence_similarity(spark, sf_dir):
    t = _known(spark, sf_dir).select(F.col("template_id").alias("n"), T.words(F.col("template")).alias("t"))
    both = tokened(spark, sf_dir).withColumn("n", F.size("tokens").cast("long")).join(t, "n").withColumn("s", T.sequence_similarity(F.col("t"), F.col("tokens")))
    return both.select("log_index", F.round("s.similarity", 9).alias("similarity"), F.col("s.n_wildcards").cast("long").alias("n_wildcards"))


@query(
    f"{_WITH}, {_POS}, {_TEMPLATES}, sc AS (SELECT log_index, n AS parsed, array_to_string(tt, ' ') AS template, truth AS event FROM tok JOIN tpl USING (n)), "
    r"""p AS (SELECT parsed, count(*) AS ps, min(event) = max(event) AS pure, max(template) AS template FROM sc GROUP BY parsed), e AS (SELECT event, count(*) AS es FROM sc GROUP BY event),
m AS (SELECT n, pure AND ps = es AS exact, regexp_replace(template, '\s+', '', 'g') = regexp_replace(regexp_replace(event, '(<\*>\s*){2,}', '<*> ', 'g'), '\s+', '', 'g') AS same FROM (SELECT parsed, event, count(*) AS n FROM sc GROUP BY ALL) JOIN p USING (parsed) JOIN e USING (event)),
q AS (SELECT sum(n) AS lines, sum(CASE WHEN exact THEN n ELSE 0 END) AS ga, sum(CASE WHEN same THEN n ELSE 0 END) AS pa, count(CASE WHEN exact THEN 1 END) AS tp, count(CASE WHEN exact AND same THEN 1 END) AS ta, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM e) AS ne FROM m),
r AS (SELECT *, round(tp / np, 4) AS gp, round(tp / ne, 4) AS gr, round(ta / np, 4) AS tpp, round(ta / ne, 4) AS tr FROM q)
SELECT round(ga / lines, 4) AS "GA", round(pa / lines, 4) AS "PA", CASE WHEN gp + gr > 0 THEN round(2 * gp * gr / (gp + gr), 4) ELSE 0.0 END AS "FGA", CASE WHEN tpp + tr > 0 THEN round(2 * tpp * tr / (tpp + tr), 4) ELSE 0.0 END AS "FTA", lines::BIGINT AS n_lines, np AS n_templates FROM r"""
)
def accuracy(spark, sf_dir):
    t = _known(spark, sf_dir).select(F.col("template_id").alias("parsed"), "template")
    scored = tokened(spark, sf_dir).select("log_index", F.size("tokens").cast("long").alias("parsed"), F.col("truth").alias("event"), F.col("truth").alias("event_template")).join(t, "parsed")
    return metrics.accuracy(scored)


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_mktsegment AS Dataset", "c_acctbal AS GA", "c_nationkey AS nation", "c_custkey AS place")


@query('SELECT c_mktsegment AS "Dataset", c_acctbal AS "GA", c_nationkey AS nation, c_custkey AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1')
def best_runs(spark, sf_dir):
    return metrics.best_runs(_runs(spark, sf_dir))


@query("""WITH b AS (SELECT c_mktsegment AS "Dataset", c_custkey::DOUBLE AS place, c_nationkey::DOUBLE AS nation FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1)
SELECT * FROM b UNION ALL SELECT 'Average', round(avg(place), 4), round(avg(nation), 4) FROM b""")
def average_row(spark, sf_dir):
    return metrics.with_average(metrics.best_runs(_runs(spark, sf_dir)).drop("GA"))


@query(f"WITH {_LINES} SELECT component, count(*) AS n FROM lines GROUP BY 1 ORDER BY 2 DESC, 1")
def value_counts(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component")


@query("SELECT w, regexp_matches(w, '^[a-z]+(_[a-z]+)+$') OR regexp_matches(w, '^[a-zA-Z]+([A-Z][a-z0-9]+)+$') AS snake_or_camel, regexp_matches(w, '[0-9]') AS numbers FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM conversations)")
def case_predicates(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("w")).distinct()
    return words.select("w", T.is_snake_or_camel(F.col("w")).alias("snake_or_camel"), T.has_numbers(F.col("w")).alias("numbers"))


@query(f"WITH {_LINES}, raw AS (SELECT log_index, concat(level, '  ', component, ': ', content) AS value FROM lines) SELECT log_index, regexp_extract(value, '^(.*?)\\s+(.*?):\\s+(.*?)$', 1) AS \"Level\", regexp_extract(value, '^(.*?)\\s+(.*?):\\s+(.*?)$', 2) AS \"Component\", regexp_extract(value, '^(.*?)\\s+(.*?):\\s+(.*?)$', 3) AS \"Content\" FROM raw")
def parse_headers(spark, sf_dir):
    raw = lines(spark, sf_dir).selectExpr("log_index", "concat(level, '  ', component, ': ', content) AS value")
    return logs.parse_headers(raw, "<Level> <Component>: <Content>").filter("matched").select("log_index", "Level", "Component", "Content")


@query(f"WITH {_LINES} SELECT log_index, CASE WHEN log_index % 2 = 0 THEN content ELSE concat(log_index, ' xx-1 a b c ', content) END AS value FROM lines")
def strip_prefix(spark, sf_dir):
    raw = lines(spark, sf_dir).selectExpr("log_index", "concat(log_index, CASE WHEN log_index % 2 = 0 THEN ' PO-' ELSE ' xx-' END, '1 a b c ', content) AS value")
    return raw.select("log_index", logs.strip_prefix(F.col("value")).alias("value"))


@query(f"WITH {_LINES} SELECT log_index, CASE event_id % 4 WHEN 0 THEN 'user <*> action <*> took <*> ms' WHEN 1 THEN 'Received block <*> of size <*> from <*>' WHEN 2 THEN 'Connection closed by <*> [ preauth ]' ELSE concat('session ', CASE WHEN event_id % 3 = 0 THEN 'opened' ELSE 'closed' END, ' for user <*>') END AS template FROM lines")
def mine_lines(spark, sf_dir):
    """The whole plan over all lines; their templates are known by construction."""
    rows = lines(spark, sf_dir).select("log_index", "content")
    found, _ = mine(rows)
    return found.select("log_index", "template")


@query(f"WITH {_LINES} SELECT log_index, regexp_extract(content, '^user\\s+(.+?)\\s+action\\s+(.+?)\\s+took\\s+(.+?)\\s+ms$', 1) || '|' || regexp_extract(content, '^user\\s+(.+?)\\s+action\\s+(.+?)\\s+took\\s+(.+?)\\s+ms$', 2) || '|' || regexp_extract(content, '^user\\s+(.+?)\\s+action\\s+(.+?)\\s+took\\s+(.+?)\\s+ms$', 3) AS \"values\" FROM lines WHERE event_id % 4 = 0")
def extract_parameters(spark, sf_dir):
    rows = lines(spark, sf_dir).filter("event_id % 4 = 0").select("log_index", "content", F.col("truth").alias("template"))
    return params.parameter_list(rows, masking.Masker([])).select("log_index", F.array_join("parameters", "|").alias("values"))


_VALUES = {
    "0": ("^user\\s+(.+?)\\s+action\\s+(.+?)\\s+took\\s+(.+?)\\s+ms$", 3),
    "1": ("^Received\\s+block\\s+(.+?)\\s+of\\s+size\\s+(.+?)\\s+from\\s+(.+?)$", 3),
    "2": ("^Connection\\s+closed\\s+by\\s+(.+?)\\s+\\[preauth\\]$", 1),
    "3": ("^session\\s+(?:opened|closed)\\s+for\\s+user\\s+(.+?)$", 1),
}
_VALUES_OF_SHAPE = " ".join(f"WHEN {shape} THEN " + " || '|' || ".join(f"regexp_extract(content, '{pattern}', {i + 1})" for i in range(n)) for shape, (pattern, n) in _VALUES.items())


@query(f"WITH {_LINES} SELECT log_index, CASE event_id % 4 {_VALUES_OF_SHAPE} END AS \"values\" FROM lines")
def extract_parameters_all(spark, sf_dir):
    """The same over lines of every shape, each by its own template."""
    rows = lines(spark, sf_dir).select("log_index", "content", F.col("truth").alias("template"))
    return params.parameter_list(rows, masking.Masker([])).select("log_index", F.array_join("parameters", "|").alias("values"))


@query(f"{_WITH}, terms AS (SELECT n AS id, unnest(tt) AS term FROM tpl), tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT id, term, tf * (ln((1 + (SELECT count(DISTINCT id) FROM terms)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)) SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM raw".replace(_TOKENS, f"{_TOKENS}, {_POS}, {_TEMPLATES}"))
def term_weights(spark, sf_dir):
    t = settle(_known(spark, sf_dir)).select(F.col("template_id").alias("id"), T.words(F.col("template")).alias("tokens"))
    return similarity.tfidf(t).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_LINES} SELECT trim(truth) AS template, min(log_index) AS kept_id, count(*) AS n FROM lines GROUP BY 1")
def merge_duplicate_templates(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.col("log_index").alias("template_id"), F.concat(F.lit(" "), "truth").alias("template"))
    return merge.merge_duplicates(rows).groupBy("template", "kept_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def coarse_groups(spark, sf_dir):
    rows = prepare(lines(spark, sf_dir))
    distinct = rows.groupBy("component", "level", "content").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.min("log_index").alias("first_index"))
    return group.coarse_groups(distinct).groupBy("component", "level", "n_tokens", "leaf_id").agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_contents"))


_ENTROPY = """es AS (SELECT n, pos, count(*) AS types, -sum(c / tot * log2(c / tot)) AS h, min(tok) AS one,
    bool_or(NOT regexp_matches(tok, '^[A-Za-z][a-z]+$') AND NOT regexp_matches(tok, '^[a-z]+(_[a-z]+)+$') AND NOT regexp_matches(tok, '^[a-zA-Z]+([A-Z][a-z0-9]+)+$')) AS odd
  FROM (SELECT *, sum(c) OVER (PARTITION BY n, pos) AS tot FROM pos) GROUP BY n, pos),
er AS (SELECT n, pos, CASE WHEN types > 1 AND round(h / log2(types), 12) * (types - 1) / 4 >= 0.8 THEN '<*>' WHEN types = 1 THEN one WHEN odd AND h > 1.8 THEN '<*>' END AS token FROM es),
et AS (SELECT n, CASE WHEN count(token) = count(*) AND bool_or(token <> '<*>') THEN string_agg(token, ' ' ORDER BY pos) END AS template FROM er GROUP BY n)"""


@query(f"{_WITH}, {_POS}, {_ENTROPY} SELECT n AS n_tokens, CASE WHEN count(DISTINCT content) = 1 THEN min(content) ELSE min(template) END AS template FROM tok JOIN et USING (n) GROUP BY n")
def entropy_templates(spark, sf_dir):
    return extract.entropy_templates(by_length(spark, sf_dir), ["n_tokens"])


@query(f"{_WITH}, each AS (SELECT n, pos, t[pos + 1] AS tok, count(*) AS c, min(log_index) AS first FROM tok, LATERAL (SELECT unnest(range(0, n)) AS pos) GROUP BY ALL) SELECT n AS n_tokens, pos, place, tok, c FROM (SELECT *, row_number() OVER (PARTITION BY n, pos ORDER BY c DESC, first, tok) AS place FROM each) WHERE place <= 5")
def top_tokens(spark, sf_dir):
    found = split.top_tokens(by_length(spark, sf_dir), ["n_tokens"])
    return found.select("n_tokens", F.col("pos").cast("long").alias("pos"), F.col("place").cast("long").alias("place"), "tok", "c")


#: Rows that the sampling operator is asked for.
SAMPLE = 400


@query(
    f"WITH {_LINES}, s AS (SELECT truth, count(*) AS c FROM lines GROUP BY 1), sh AS (SELECT truth, round_even(c / (SELECT sum(c) FROM s) * {float(SAMPLE)}, 0) AS share FROM s) "
    "SELECT log_index, truth FROM (SELECT l.log_index, l.truth, share, row_number() OVER (PARTITION BY l.truth ORDER BY md5(concat('42:', l.log_index)), l.log_index) AS place FROM lines l JOIN sh ON l.truth = sh.truth) WHERE place <= share"
)
def stratified_sample(spark, sf_dir):
    rows = sample.stratified_sample(lines(spark, sf_dir).select("log_index", "truth"), "truth", "log_index", SAMPLE)
    return sample.shuffled(rows, "log_index")


#: Datasets whose rules are applied to lines, one column for each.
_RULED = ("HDFS", "OpenStack", "Spark", "Zookeeper", "Thunderbird", "Linux", "Andriod", "Apache", "Proxifier", "OpenSSH", "Mac")


def _ruled_sql(name: str) -> str:
    text = "line"
    for pattern, to in [*((p, "") for p in config.DATASETS[name].filters), *((p, "<*>") for p in config.DATASETS[name].patterns)]:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return f'{text} AS "{name}"'


#: A line with something for the rules of every dataset.
_RICH = """concat(content, ' (', event_id % 7, ' KB) ', user_id, 'ms ', user_id, ' MB _C', event_id % 5, ' ::ffff:10.0.0.', event_id % 9, ' LOCAL(', event_id, ') a_b:c:d HTTP/1.', event_id % 2,
  ' a-b-c-d-', event_id, ' 10.0.0.1,10.0.0.', event_id % 9, ' 0aF', event_id, ' www.ab-c', user_id, '.example.org:443 <', event_id, ' sec 12:34:', 10 + event_id % 50, ' 0a:1b:2c:3d:4e:5f (IPv6) blk_-', event_id, ' /usr/lib/x', user_id, '.so')"""


@query(f"WITH {_LINES} SELECT log_index, {', '.join(map(_ruled_sql, _RULED))} FROM (SELECT log_index, {_RICH} AS line FROM lines)")
def dataset_rules(spark, sf_dir):
    """The filters and patterns of every registered dataset that has some."""
    rows = lines(spark, sf_dir).selectExpr("log_index", f"{_RICH} AS line")
    return rows.select("log_index", *[masking.preprocess(F.col("line"), config.DATASETS[d].filters, config.DATASETS[d].patterns).alias(d) for d in _RULED])


@query("SELECT count(*) AS total_size FROM events")
def total_cluster_size(spark, sf_dir):
    """The sizes of all online clusters add up to the lines."""
    changes = online(lines(spark, sf_dir).select("log_index", "content"), depth=10, threshold=0.4)
    return metrics.total_size(changes.groupBy("cluster_id").agg(F.max("cluster_size").alias("n_matched")))


@query(f"WITH {_LINES} SELECT row_number() OVER (ORDER BY truth) AS ordinal, row_number() OVER (ORDER BY truth) AS template_id, truth AS template FROM (SELECT DISTINCT truth FROM lines)")
def merge_fold(spark, sf_dir):
    """Templates of which no two are compatible: each keeps its place."""
    rows = lines(spark, sf_dir).select("truth").distinct()
    new = rows.withColumn("ordinal", F.row_number().over(Window.orderBy("truth")).cast("long")).withColumnRenamed("truth", "template")
    return merge.merge_fold(new).select("ordinal", "template_id", "template")


_SPECIAL = "concat('user <*> action ', event_type, ' took <*> ms')"
_GENERAL = "user <*> action <*> took <*> ms"


@query(
    f"WITH t AS (SELECT template, row_number() OVER (ORDER BY template = '{_GENERAL}', template) AS ordinal FROM (SELECT {_SPECIAL} AS template FROM events UNION SELECT concat('closed ', event_type) FROM events UNION SELECT '{_GENERAL}')) "
    f"SELECT ordinal, CASE WHEN template LIKE 'user%' THEN max(ordinal) OVER () ELSE ordinal END AS template_id, CASE WHEN template LIKE 'user%' THEN '{_GENERAL}' ELSE template END AS template FROM t"
)
def merge_fold_absorbs(spark, sf_dir):
    """A general template that comes last takes in the special ones, and leaves alone what doesn't fit it."""
    kinds = table(spark, sf_dir, "events").selectExpr("event_type").distinct()
    made = kinds.selectExpr(f"explode(array({_SPECIAL}, concat('closed ', event_type), '{_GENERAL}')) AS template").distinct()
    order = Window.orderBy(F.col("template") == _GENERAL, "template")
    return merge.merge_fold(made.withColumn("ordinal", F.row_number().over(order).cast("long"))).select("ordinal", "template_id", "template")


#: Lines of uneven and short lengths, and the templates they are matched with.
_UNEVEN = """CASE event_id % 6 WHEN 0 THEN concat('job ', event_type, ' has ended now') WHEN 1 THEN concat('job ', event_type, ' a b has ended now')
  WHEN 2 THEN concat('job ', event_type, ' <*> ', event_id % 7, ' has ended now') WHEN 3 THEN 'halt' WHEN 4 THEN 'stop now' ELSE concat('job long_run ', user_id % 11, ' has ended ', CASE WHEN user_id % 2 = 0 THEN 'now' ELSE 'late' END) END"""
_FITTING = {1: "job <*> has ended now", 2: "halt", 3: "stop now", 4: "job <*> has <*> late"}


@query(
    f"WITH c AS (SELECT DISTINCT {_UNEVEN} AS content FROM events), cap AS (SELECT content, string_split(regexp_extract(content, '^job (.*) has ended (now|late)$', 1), ' ') AS v FROM c) "
    "SELECT content, CASE WHEN content = 'halt' THEN 2 WHEN content = 'stop now' THEN 3 WHEN content LIKE '% late' THEN 4 ELSE 1 END::BIGINT AS template_id FROM cap "
    "WHERE content IN ('halt', 'stop now') OR len(v) = 1 OR len(list_filter(v, lambda x: regexp_matches(x, '^[a-z]+(_[a-z]+)+$'))) = 0"
)
def match_uneven_lengths(spark, sf_dir):
    """A wildcard may stand for several tokens unless one is in snake case; lines under three tokens have keys too."""
    contents = table(spark, sf_dir, "events").selectExpr(f"{_UNEVEN} AS content").distinct()
    templates = spark.createDataFrame(list(_FITTING.items()), "template_id long, template string")
    return match.match_templates(contents.withColumn("tokens", T.words(F.col("content"))), templates)


_SPELT = "explode(array(p_type, lower(p_type), replace(p_type, ' ', '_'), lower(replace(p_type, ' ', '_')), replace(initcap(p_type), ' ', ''), concat(p_brand, p_size))) AS w"
_CAMEL = "concat(upper(x[1]), lower(x[2:]))"


@query(
    f"WITH w AS (SELECT DISTINCT unnest([p_type, lower(p_type), replace(p_type, ' ', '_'), lower(replace(p_type, ' ', '_')), array_to_string(list_transform(string_split(p_type, ' '), lambda x: {_CAMEL}), ''), concat(p_brand, p_size)]) AS w FROM part), "
    "p AS (SELECT w, regexp_extract_all(w, '[a-z]+|[A-Z][a-z0-9]*') AS parts FROM w) "
    "SELECT w, regexp_matches(w, '^[a-zA-Z]+(_[a-zA-Z]+)+$') AS snake, regexp_matches(w, '^[a-zA-Z]+([A-Z][a-z0-9]+)+(\\(\\))?$') AND len(parts) >= 2 AND len(list_filter(parts, lambda x: regexp_matches(x, '^[A-Za-z][a-z]+$'))) > 0 AS camel, "
    "NOT regexp_matches(w, '[0-9a-z]') AS capital FROM p"
)
def word_cases(spark, sf_dir):
    words = table(spark, sf_dir, "part").selectExpr(_SPELT).distinct()
    return words.select("w", T.is_snake(F.col("w")).alias("snake"), T.is_camel(F.col("w")).alias("camel"), T.is_all_capital(F.col("w")).alias("capital"))


#: Customers are linked with the one so many places further on, which gives as many chains.
_CHAINS = 25


@query(f"WITH l AS (SELECT c_custkey AS id, min(c_custkey) OVER () AS low, count(*) OVER () AS n FROM customer) SELECT id, min(id) OVER (PARTITION BY (id - low) % {_CHAINS}) AS component FROM l WHERE n > {_CHAINS}")
def connected_components(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").selectExpr("c_custkey AS a")
    links = ids.join(ids.select(F.col("a").alias("b")), F.col("a") + _CHAINS == F.col("b"))
    return similarity.connected(links, settle)


@query(
    f"WITH {_SIMILAR}, d AS (SELECT len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) AS similarity FROM s x JOIN s y ON x.id < y.id) "
    "SELECT round(max(similarity), 9) AS most, round(min(similarity), 9) AS least, round(avg(similarity), 9) AS mean FROM d WHERE similarity >= 0.6"
)
def similarity_stats(spark, sf_dir):
    return similarity.similar_pair_stats(_part_tokens(spark, sf_dir), 0.6).select(*[F.round(c, 9).alias(c) for c in ("most", "least", "mean")])


@query(
    f"{_WITH}, e AS (SELECT n, string_split(min(content), ' ') AS a, string_split(max(content), ' ') AS b FROM tok GROUP BY n) "
    "SELECT n AS n_tokens, array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN a[i] = b[i] THEN a[i] ELSE '<*>' END), ' ') AS template FROM e"
)
def pair_templates(spark, sf_dir):
    """What the first and the last content of each length have in common."""
    ends = by_length(spark, sf_dir).groupBy("n_tokens").agg(F.min_by("tokens", "content").alias("a"), F.max_by("tokens", "content").alias("b"))
    return ends.select("n_tokens", F.array_join(T.pair_template(F.col("a"), F.col("b")), " ").alias("template"))


@query()
def online_clusters(spark, sf_dir):
    rows = lines(spark, sf_dir).select("log_index", "content")
    return online(rows, depth=10, threshold=0.4)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which templates occur, how often?"""
    _, templates = mine(lines(spark, sf_dir).select("log_index", "content"))
    return templates.orderBy(F.desc("n_matched"), "template")
