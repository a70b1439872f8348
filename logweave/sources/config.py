"""Configuration files and recorded calls."""

from __future__ import annotations

import configparser
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masking import Masker, MaskRule
from ..schemas import LLM_RECORD

#: Which miner a configuration is for: ``batch`` mines whole logs or chunks, ``online`` takes line by line.
ENGINES = ("batch", "online")
# The section that has the miner's settings.
MAIN = "DRAIN"


@dataclass
class Config:
    """The settings that have an effect. Keys come from the environment (``LLM_API_KEY``), never from files."""

    engine: str = "batch"
    depth: int = 4
    sim_th: float = 0.4
    max_children: int = 100
    max_clusters: int | None = None
    extra_delimiters: list[str] = field(default_factory=list)
    parametrize_numeric_tokens: bool = True
    mask_prefix: str = "<"
    mask_suffix: str = ">"
    masking: list[MaskRule] = field(default_factory=list)
    parameter_cache: int = 3000
    snapshot_minutes: int = 5
    snapshot_compress: bool = True
    llm_provider: str | None = None
    llm_model: str | None = None
    llm_thinking: bool = False

    @property
    def llm_key(self) -> str | None:
        return os.environ.get("LLM_API_KEY")

    @property
    def online_options(self) -> dict:
        """What ``streaming.online.online`` takes of it."""
        return {"delimiters": self.extra_delimiters, "depth": self.depth, "threshold": self.sim_th, "max_children": self.max_children, "numeric_wildcards": self.parametrize_numeric_tokens}

    @property
    def masker(self) -> Masker:
        return Masker(self.masking, self.mask_prefix, self.mask_suffix)


def load_config(path: str) -> Config:
    """Read an INI file; sections and options that are missing keep their defaults."""
    parser = configparser.ConfigParser(interpolation=None)
    if not parser.read(path, encoding="utf-8"):
        raise FileNotFoundError(path)
    d = Config()

    def get(section: str, name: str, kind, default):
        if not parser.has_option(section, name):
            return default
        raw = parser.get(section, name).strip()
        return raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)

    def rules(text: str) -> list[MaskRule]:
        return [MaskRule(x["regex_pattern"], x["mask_with"]) for x in json.loads(text)]

    main = MAIN
    config = Config(
        engine=get(main, "engine", str, d.engine),
        depth=get(main, "depth", int, d.depth),
        sim_th=get(main, "sim_th", float, d.sim_th),
        max_children=get(main, "max_children", int, d.max_children),
        max_clusters=get(main, "max_clusters", int, None),
        extra_delimiters=get(main, "extra_delimiters", lambda s: list(__import__("ast").literal_eval(s)), []),
        parametrize_numeric_tokens=get(main, "parametrize_numeric_tokens", bool, d.parametrize_numeric_tokens),
        mask_prefix=get("MASKING", "mask_prefix", str, d.mask_prefix),
        mask_suffix=get("MASKING", "mask_suffix", str, d.mask_suffix),
        masking=get("MASKING", "masking", rules, []),
        parameter_cache=get("MASKING", "parameter_extraction_cache_capacity", int, d.parameter_cache),
        snapshot_minutes=get("SNAPSHOT", "snapshot_interval_minutes", int, d.snapshot_minutes),
        snapshot_compress=get("SNAPSHOT", "compress_state", bool, d.snapshot_compress),
        llm_provider=get(main, "LLM_provider", str, None),
        llm_model=get(main, "LLM_model", str, None),
        llm_thinking=get(main, "LLM_thinking", bool, False),
    )
    if config.engine.lower() not in ENGINES:
        raise ValueError(f"engine {config.engine!r} isn't one of {', '.join(ENGINES)}")
    if config.depth < 3:
        raise ValueError("depth must be 3 or more")
    return config


# Header formats of the public log collections. Spaces stand for white space, literals are patterns.
FORMATS = {
    "HPC": "<LogId> <Node> <Component> <State> <Time> <Flag> <Content>",
    "OpenStack": r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>",
    "BGL": "<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>",
    "HDFS": "<Date> <Time> <Pid> <Level> <Component>: <Content>",
    "Hadoop": r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>",
    "Spark": "<Date> <Time> <Level> <Component>: <Content>",
    "Zookeeper": r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>",
    "Thunderbird": r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>",
    "Windows": "<Date> <Time>, <Level>                  <Component>    <Content>",
    "Linux": r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>",
    "Andriod": "<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>",
    "HealthApp": r"<Time>\|<Component>\|<Pid>\|<Content>",
    "Apache": r"\[<Time>\] \[<Level>\] <Content>",
    "Proxifier": r"\[<Time>\] <Program> - <Content>",
    "OpenSSH": r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>",
    "Mac": r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>",
    "Thunderbird_epd": r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>",
    "Audit": r"type=<Type> msg=audit\(<Time>\): <Content>",
}
# What each collection's lines lose (filters) and what becomes <*> in them (patterns), in order.
FILTERS = {"OpenStack": [r"HTTP\/\d+\.\d+"]}
PATTERNS = {
    "OpenStack": [r"(\w+-\w+-\w+-\w+-\w+)", r"HTTP\/\d+\.\d+", r"(?:\d{1,3}\.){3}\d{1,3},(?:\d{1,3}\.){3}\d{1,3}"],
    "HDFS": [r"blk_-?\d+"],
    "Spark": [r"\b\d+\s*(B|KB|MB|GB)\b"],
    "Zookeeper": [r"\b\d+ms\b"],
    "Thunderbird": [r"::ffff:(?:\d{1,3}\.){3}\d{1,3}", r"(\d+\.){3}\d+", r"\bLOCAL\(\d+\)", r"_([A-Z]\d+)", r"\b\d+(B|kB|mB)\b"],
    "Linux": [r"[a-z_]+:[a-z_]+:[a-z_]+"],
    "Andriod": [r"(/[\w-]+)+", r"([\w-]+\.){2,}[\w-]+", r"\b(\-?\+?\d+)\b|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b", r"-\<\*\>"],
    "Apache": [r"\/(?:\w+\/){2,}\w+\.\w+$"],
    "Proxifier": [r"\(\d+(\.\d+)?\s(?:K|M|G|T)B\)", r"\(IPv[46]\)", r"<\d+\ssec", r"([\w-]+\.)+[\w-]+(:\d+)?", r"\d{2}:\d{2}(:\d{2})*"],
    "OpenSSH": [r"(\d+\.){3}\d+", r"([\w-]+\.){2,}[\w-]+", r"(\.\d+){2,}"],
    "Mac": [r"([\w-]+\.){2,}[\w-]+", r"([a-f0-9]{2}:){5}[a-f0-9]{2}"],
}


@dataclass(frozen=True)
class Dataset:
    """A registered collection: its header format and its own rules."""

    name: str
    format: str
    filters: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


DATASETS = {name: Dataset(name, fmt, tuple(FILTERS.get(name, ())), tuple(PATTERNS.get(name, ()))) for name, fmt in FORMATS.items()}
#: Folder suffix and file marker of each mode.
MODES = {"2K": ("loghub-2K", "2k"), "FULL": ("datasets_full", "full"), "FULL50K": ("datasets_50K", "50K"), "FULL50KRAW": ("datasets_50K", "50K"), "LOGBASE": ("logbase", "full")}


def dataset_paths(root: str, dataset: str, mode: str = "2K", labels: str = "corrected") -> dict[str, str]:
    """Where a dataset's labelled lines and template list are."""
    if mode.upper() not in MODES or labels not in ("corrected", "raw"):
        raise ValueError("unknown mode or label type")
    folder, mark = MODES[mode.upper()]
    suffix = "_corrected" if labels == "corrected" and mode.upper() != "FULL50KRAW" else ""
    base = f"{root.rstrip('/')}/{folder}/{dataset}/{dataset}_{mark}.log"
    return {"log": base, "structured": f"{base}_structured{suffix}.csv", "templates": f"{base}_templates{suffix}.csv"}


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Recorded calls of a JSON file, a row for each."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", LLM_RECORD)).alias("call")).select("call.*")


def cached_templates(samples: DataFrame, calls: DataFrame, ordered: bool = True) -> DataFrame:
    """(cluster_id, template): ``samples`` (cluster_id, lines array) whose lines a recorded call has.

    ``ordered`` asks for the same lines in the same order; else order, back-ticks and extra spaces don't matter.
    """
    def key(lines):
        if ordered:
            return F.array_join(lines, "\n")
        clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.replace(x, F.lit("`"), F.lit("")), r"\s+", " ")))
        return F.array_join(F.array_sort(clean), "\n")

    each = calls.select(F.explode("inputs").alias("i"), "output").select(F.col("i.Id").alias("id"), F.split("i.logs", "\n").alias("lines"), "output")
    answer = F.get(F.filter("output", lambda o: o["Id"] == F.col("id")), F.lit(0))["template"]
    known = each.select(key(F.col("lines")).alias("_k"), answer.alias("template")).filter(F.length("template") > 0).groupBy("_k").agg(F.min("template").alias("template"))
    return samples.withColumn("_k", key(F.col("lines"))).join(known, "_k").select("cluster_id", "template")
