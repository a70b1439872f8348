"""Mining: from lines to templates and which line has which.

All stages after preparation work on distinct contents with counts. A chunk is matched against the templates known so
far; what is left is grouped, split and extracted, and its templates are merged into the store. One chunk is the
default; several give what streaming gives.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import correct, masking, tokens
from ..operators import extract, group, match, merge, metrics, split
from ..operators.distinct import on_distinct
from ..sources import config, logs
from .profiler import NullProfiler, Profiler
from .state import settle

#: The phases that a profiler times.
PHASES = MATCHING, GROUPING, EXTRACTION, MERGING = "matching", "grouping", "extraction", "merging"
LEAF = [*group.KEY, "leaf_id"]
CLUSTER = [*LEAF, "branch"]


def prepare(lines: DataFrame, masker: masking.Masker | None = None, filters: Sequence[str] = (), patterns: Sequence[str] = (), user_strings: Sequence[str] = ()) -> DataFrame:
    """(log_index, component, level, content, tokens): masked, corrected, cut to tokens; content is the tokens joined."""
    columns = set(lines.columns)
    part = {c: masking.or_wildcard(F.col(c)) if c in columns else F.lit("<*>") for c in ("component", "level")}
    text = masking.preprocess(F.trim(F.coalesce(F.col("content"), F.lit(""))), filters, patterns)
    text = (masker or masking.Masker(masking.WILDCARD_RULES)).mask(text)
    rows = lines.select("log_index", part["component"].alias("component"), part["level"].alias("level"), text.alias("content"))
    # masking makes most lines equal; the rest is done once for each distinct content
    rows = on_distinct(rows.withColumnRenamed("content", "masked"), "masked", {"tokens": lambda t: tokens.tokens(correct.correct_input(t, user_strings))})
    return rows.select("log_index", "component", "level", F.array_join("tokens", " ").alias("content"), "tokens")


def distinct_contents(prepared: DataFrame) -> DataFrame:
    """(component, level, content, tokens, n, first_index), added up on the map side."""
    return prepared.groupBy("component", "level", "content").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.min("log_index").alias("first_index"))


@dataclass
class State:
    """What is known between chunks: templates, contents not extracted yet, and contents with their template."""

    templates: DataFrame | None = None  # template_id, template
    pending: DataFrame | None = None  # component, level, content, tokens, n, first_index
    assigned: DataFrame | None = None  # component, level, content, template_id


def _fine(leaves: DataFrame) -> DataFrame:
    clusters = split.variance_split(leaves, LEAF)
    return clusters.withColumn("cluster_first", F.min("first_index").over(Window.partitionBy(*CLUSTER)))


def _extracted(clusters: DataFrame, provider: extract.TemplateProvider, known: Callable[[Column], Column]) -> DataFrame:
    """(component, level, content, template, ordinal): each content's template and its place in the order of merging."""
    templates = settle(extract.entropy_templates(clusters, CLUSTER, known))
    open_ = templates.filter("template IS NULL").select(*CLUSTER)
    undecided = F.col("template").isNull().alias("undecided")
    order = templates.select(*CLUSTER, undecided)
    if not isinstance(provider, extract.NullProvider):
        # a handful of lines for each open cluster goes to the provider, in one call
        firsts = clusters.join(open_, CLUSTER).groupBy(*CLUSTER).agg(F.min("first_index").alias("cluster_id"))
        samples = extract.first_samples(clusters.join(open_, CLUSTER), CLUSTER).join(firsts, CLUSTER).orderBy("cluster_id", "place").select("cluster_id", "content").collect()
        groups: dict[int, list[str]] = {}
        for r in samples:
            groups.setdefault(r.cluster_id, []).append(r.content)
        answers = provider(list(groups.items())) if groups else {}
        if answers:
            given = clusters.sparkSession.createDataFrame(sorted(answers.items()), "cluster_id long, given string")
            templates = templates.join(firsts, CLUSTER, "left").join(F.broadcast(given), "cluster_id", "left").select(*CLUSTER, F.coalesce("template", "given").alias("template"))
    applied = extract.apply_templates(clusters, templates, CLUSTER)
    first = clusters.select(*CLUSTER, "key_first", "cluster_first").distinct()
    placed = applied.join(order, CLUSTER).join(first, CLUSTER)
    place = F.struct("undecided", (-F.col("n_tokens")).alias("t"), "key_first", "leaf_id", "cluster_first", "place", "template")
    return placed.select("component", "level", "content", "template", place.alias("rank"))


def mine_chunk(prepared: DataFrame, state: State | None = None, last: bool = True, depth: int = 500, provider: extract.TemplateProvider | None = None, known: Callable[[Column], Column] = tokens.in_vocabulary, combine: merge.Combine | None = None, profiler: Profiler | NullProfiler | None = None) -> State:
    """The state after one more chunk of prepared lines; ``profiler`` times the four ``PHASES``."""
    state, timer = state or State(), profiler or NullProfiler()
    keys = ["component", "level", "content"]
    hits = None
    with timer.section(MATCHING):
        distinct = fresh = settle(distinct_contents(prepared))
        if state.templates is not None:
            found = settle(match.match_templates(distinct.select("content", "tokens"), state.templates))
            hits = distinct.join(found, "content").select(*keys, "template_id")
            fresh = match.unmatched(distinct, found)
    if state.pending is not None:
        both = fresh.select(*keys, "tokens", "n", "first_index").unionByName(state.pending)
        fresh = both.groupBy(*keys).agg(F.first("tokens").alias("tokens"), F.sum("n").alias("n"), F.min("first_index").alias("first_index"))
    with timer.section(GROUPING):
        leaves = settle(group.ready(group.coarse_groups(fresh, depth), last))
        clusters = settle(_fine(leaves.filter("ready").drop("ready")))
    pending = leaves.filter("NOT ready").select(*keys, "tokens", "n", "first_index")
    with timer.section(EXTRACTION):
        extracted = settle(_extracted(clusters, provider or extract.NullProvider(), known))
    new = extracted.select("rank", "template").distinct().withColumn("ordinal", F.row_number().over(Window.orderBy("rank")).cast("long"))
    with timer.section(MERGING):
        new = settle(new)
        placed = settle(merge.merge_fold(new.select("ordinal", "template"), state.templates, combine))
    templates = placed.select("template_id", "template").distinct()
    mined = extracted.join(new.select("rank", "ordinal"), "rank").join(placed.filter("ordinal IS NOT NULL").select("ordinal", "template_id"), "ordinal").select(*keys, "template_id")
    moved = placed.filter("old_id IS NOT NULL").select(F.col("old_id").alias("_old"), F.col("template_id").alias("_new"))

    def current(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(moved), F.col("template_id") == F.col("_old")).select(*keys, F.col("_new").alias("template_id"))

    parts = [mined, *(current(d) for d in (hits, state.assigned) if d is not None)]
    assigned = parts[0]
    for p in parts[1:]:
        assigned = assigned.unionByName(p)
    assigned = assigned.groupBy(*keys).agg(F.min("template_id").alias("template_id"))
    if last:
        final = settle(merge.merge_duplicates(templates.withColumn("template", correct.correct_final(F.col("template")))))
        assigned = assigned.join(F.broadcast(final.select("template_id", "kept_id")), "template_id").select(*keys, F.col("kept_id").alias("template_id"))
        templates = final.select(F.col("kept_id").alias("template_id"), "template").distinct()
    return State(settle(templates), settle(pending), settle(assigned))


def assignment(prepared: DataFrame, state: State) -> DataFrame:
    """(log_index, template_id, template) of all prepared lines."""
    known = state.assigned.join(state.templates, "template_id")
    return prepared.select("log_index", "component", "level", "content").join(known, ["component", "level", "content"]).select("log_index", "template_id", "template")


def template_table(prepared: DataFrame, state: State) -> DataFrame:
    """(template_id, template, n_matched)."""
    return assignment(prepared, state).groupBy("template_id", "template").agg(F.count(F.lit(1)).alias("n_matched"))


def mine(lines: DataFrame, chunk_size: int | None = None, masker: masking.Masker | None = None, filters: Sequence[str] = (), patterns: Sequence[str] = (), user_strings: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame]:
    """Assignment and templates of (log_index, [component, level,] content).

    ``chunk_size`` cuts by log_index into chunks that are mined one after the other.
    """
    prepared = settle(prepare(lines, masker, filters, patterns, user_strings))
    if chunk_size is None:
        state = mine_chunk(prepared, **options)
    else:
        top = prepared.agg(F.max("log_index")).first()[0]
        chunks = 0 if top is None else top // chunk_size + 1
        state = State()
        for i in range(chunks):
            part = prepared.filter(F.col("log_index").between(i * chunk_size, (i + 1) * chunk_size - 1))
            state = mine_chunk(part, state, last=i == chunks - 1, **options)
        if not chunks:
            state = mine_chunk(prepared, **options)
    return assignment(prepared, state), template_table(prepared, state)


def evaluate(lines: DataFrame, truth: DataFrame, **options) -> DataFrame:
    """One row of scores of ``lines`` mined against (log_index, event, event_template)."""
    found, _ = mine(lines, **options)
    return _scores(found, truth)


def _scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    scored = found.select("log_index", F.col("template_id").cast("string").alias("parsed"), "template").join(truth, "log_index")
    return metrics.accuracy(scored)


def evaluate_dataset(spark: SparkSession, dataset: str, paths: dict[str, str], **options) -> dict:
    """A run's row, with the names of ``METRICS``: a registered dataset's labelled lines, mined by its rules and scored."""
    rules = config.DATASETS[dataset]
    structured = logs.read_structured(spark, paths["structured"])
    truth = structured.select(F.col("LineId").cast("long").alias("log_index"), F.col("EventId").alias("event"), F.col("EventTemplate").alias("event_template"))
    timer, began = Profiler(), time.perf_counter()
    found, templates = mine(logs.engine_lines(structured), filters=rules.filters, patterns=rules.patterns, profiler=timer, **options)
    found = settle(found)
    took = time.perf_counter() - began
    score = _scores(found, truth).first()
    phases = dict(zip(("Match", "Group", "Extract", "Correct"), (timer.seconds[p] for p in PHASES), strict=True))
    return {"Dataset": dataset, **{k: score[k] for k in ("GA", "PA", "FGA", "FTA")}, "Dura": took, "#Line": score.n_lines, "#Tpl": templates.count(), "#Invoke": 0, "#Tokens": 0, **phases}
