"""Search requests: defaults, checks, and the clean-up a form needs."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from dwellspark.functions.text import strip_whitespace
from dwellspark.schema import DEFAULT_LIMIT, REQUEST

# The bounds of a request.
MIN_LIMIT = 1
MAX_LIMIT = 100
FORM_MAX_LIMIT = 50
NOT_NEGATIVE = ["price_min", "price_max", "rooms_min", "rooms_max"]


@dataclass(frozen=True)
class SearchRequest:
    """One search. An inverted range is allowed and finds nothing."""

    query: str
    limit: int = DEFAULT_LIMIT
    price_min: int | None = None
    price_max: int | None = None
    rooms_min: float | None = None
    rooms_max: float | None = None
    city: str | None = None
    location: str | None = None
    has_parking: bool | None = None
    has_elevator: bool | None = None
    furnished: bool | None = None

    def __post_init__(self):
        if not self.query or not self.query.strip():
            raise ValueError("query is empty")
        if not MIN_LIMIT <= self.limit <= MAX_LIMIT:
            raise ValueError("limit out of range")
        for name in NOT_NEGATIVE:
            value = getattr(self, name)
            if value is not None and value < 0:
                raise ValueError(f"{name} is negative")

    def as_table(self, spark: SparkSession, query_id: int = 1) -> DataFrame:
        row = {"query_id": query_id, **asdict(self)}
        return spark.createDataFrame([tuple(row[name] for name in REQUEST.names)], REQUEST)


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests with the default limit filled in, and the others with a ``reason``."""
    filled = requests.withColumn("limit", F.coalesce("limit", F.lit(DEFAULT_LIMIT)))
    reason = F.when(F.coalesce(strip_whitespace(F.col("query")) == "", F.lit(True)), F.lit("query is empty")).when(
        ~F.col("limit").between(MIN_LIMIT, MAX_LIMIT), F.lit("limit out of range")
    )
    for name in NOT_NEGATIVE:
        if name in requests.columns:
            reason = reason.when(F.col(name) < 0, F.lit(f"{name} is negative"))
    marked = filled.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def normalize_ui_filters(requests: DataFrame) -> DataFrame:
    """Form input: a bound of zero or less is no bound, names are stripped, the limit is the slider's."""
    changed = {name: F.when(F.col(name) > 0, F.col(name)) for name in NOT_NEGATIVE}
    changed |= {name: F.nullif(F.trim(F.col(name)), F.lit("")) for name in ("city", "location")}
    changed["limit"] = F.greatest(
        F.lit(MIN_LIMIT), F.least(F.lit(FORM_MAX_LIMIT), F.coalesce("limit", F.lit(DEFAULT_LIMIT)))
    )
    return requests.withColumns(changed)
