"""Keyword lists that drive the rule classifier.

A lexicon is data: keep it as a table ``(group, label, term, priority, action)`` and load it with
``Lexicon.from_table``. Groups are negative, positive, neutral, contrast, both_ways, high, low,
mild, stop and category; ``label``, ``priority`` and ``action`` belong to category rows. Terms are
matched as substrings of the padded lower-case text, so blanks around a term are meaningful, and
a term listed twice counts twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.schema import ValidationError

GROUPS = ["negative", "positive", "neutral", "contrast", "both_ways", "high", "low", "mild", "stop"]
TABLE_SCHEMA = "group string, label string, term string, priority int, action string"
MAX_TERMS = 100_000
MAX_BYTES = 16 << 20  # of all terms, as they become part of the plan

# Words that never become keywords, and the label when no category term occurs.
KEYWORD_STOP_WORDS = (
    "the a an and or but in on at of to is are was were be been for with that this it its as by "
    "from near very more much have has had not no so than then there their they them we our us i "
    "my me you your"
).split()
FALLBACK_CATEGORY = "Other"


@dataclass
class Lexicon:
    negative: list[str] = field(default_factory=list)
    positive: list[str] = field(default_factory=list)
    neutral: list[str] = field(default_factory=list)
    contrast: list[str] = field(default_factory=list)
    both_ways: list[str] = field(default_factory=list)
    high: list[str] = field(default_factory=list)
    low: list[str] = field(default_factory=list)
    mild: list[str] = field(default_factory=list)
    stop: list[str] = field(default_factory=lambda: list(KEYWORD_STOP_WORDS))
    categories: dict[str, list[str]] = field(default_factory=dict)  # in order of priority
    actions: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_table(cls, table: DataFrame) -> Lexicon:
        """Read a lexicon table; it becomes literals of the plan, so its size is checked."""
        rows = table.select("group", "label", "term", "priority", "action").limit(MAX_TERMS + 1).collect()
        if len(rows) > MAX_TERMS:
            raise ValidationError(f"a lexicon may hold {MAX_TERMS} terms at most")
        if sum(len((r["term"] or "").encode()) for r in rows) > MAX_BYTES:
            raise ValidationError(f"the terms of a lexicon may take {MAX_BYTES} bytes at most")
        unknown = {r["group"] for r in rows} - set(GROUPS) - {"category"}
        if unknown:
            raise ValidationError(f"unknown lexicon group(s): {sorted(map(str, unknown))}")
        lists = {g: [r["term"] for r in rows if r["group"] == g] for g in GROUPS}
        if not lists["stop"]:
            lists["stop"] = list(KEYWORD_STOP_WORDS)
        ranked = sorted((r for r in rows if r["group"] == "category"), key=lambda r: r["priority"])
        categories: dict[str, list[str]] = {}
        actions: dict[str, str] = {}
        for r in ranked:
            categories.setdefault(r["label"], []).append(r["term"])
            if r["action"] is not None:
                actions[r["label"]] = r["action"]
        return cls(**lists, categories=categories, actions=actions)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(g, None, t, None, None) for g in GROUPS for t in getattr(self, g)]
        rows += [
            ("category", label, term, rank, self.actions.get(label))
            for rank, (label, terms) in enumerate(self.categories.items()) for term in terms
        ]
        return spark.createDataFrame(rows, TABLE_SCHEMA)


def load_lexicon(spark: SparkSession, path: str) -> Lexicon:
    """Read a lexicon stored as CSV (with header) or Parquet."""
    if path.endswith(".csv"):
        table = spark.read.option("header", True).option("escape", '"').csv(path)
        return Lexicon.from_table(table.withColumn("priority", F.col("priority").cast("int")))
    return Lexicon.from_table(spark.read.parquet(path))


# A small lexicon for the generated texts the tests and the registered queries run on.
SAMPLE = Lexicon(
    negative=["heat", "fan", "trash", "odor", "tv"],
    positive=["great", "ción", "the ", "great"],
    neutral=["license", "und ", "gate"],
    contrast=[" und ", " in "],
    both_ways=["exam"],
    high=["tear", "heed", "urgent"],
    low=["rest", "stone"],
    mild=["mit ", "la "],
    categories={
        "Internet": ["token", "mail", "@"],
        "Food Service": ["tea", "reed"],
        "Transportation": ["hand", "mit "],
        "Academic": ["exam", "date"],
        "Safety": ["best", "tear"],
        "Cleanliness": ["trash", "bleed"],
        "Environment": ["heat", "odor"],
        "Software": ["license", "data", "apache"],
        "Hardware": ["fan", "tv", "test"],
        "Other": ["la ", "ich "],
        "Facilities": ["gate", "shed", "stone"],
    },
    actions={
        "Internet": "Check the network.",
        "Food Service": "Talk to the caterer.",
        "Transportation": "Add capacity at busy hours.",
        "Academic": "Publish schedules earlier.",
        "Safety": "Send the safety officer.",
        "Cleanliness": "Clean more often.",
        "Environment": "Improve the ventilation.",
        "Software": "Fix and test the system.",
        "Hardware": "Repair or replace the device.",
        "Other": "Name someone in charge.",
        "Facilities": "Plan a repair.",
    },
)
