"""Registries that a user extends at run time: cleaning steps with hooks, metrics, match methods, labels, and a read-only SQL door."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from lodestone.streaming.committed import Committed

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Cleaning:
    """Named DataFrame steps, and hooks that run before and after each."""

    steps: dict[str, Step] = field(default_factory=dict)
    before: list[Callable[[str, DataFrame], DataFrame]] = field(default_factory=list)
    after: list[Callable[[str, DataFrame], DataFrame]] = field(default_factory=list)

    def register(self, name: str) -> Callable[[Step], Step]:
        def take(step: Step) -> Step:
            if name in self.steps:
                raise ValueError(f"step {name} is there already")
            self.steps[name] = step
            return step

        return take

    def run(self, df: DataFrame, names: Iterable[str] | None = None, *, skip: Iterable[str] = ()) -> DataFrame:
        """The steps in the order of names (or of registration) but those to skip; unknown names raise KeyError."""
        skipped = set(skip)
        for name in names if names is not None else list(self.steps):
            if name in skipped:
                continue
            for hook in self.before:
                df = hook(name, df)
            df = self.steps[name](df)
            for hook in self.after:
                df = hook(name, df)
        return df

    def run_in_parts(self, df: DataFrame, tables: Committed, *, by: Iterable[str], parts: int, **how) -> DataFrame:
        """run() over `parts` parts of df by a hash of `by`, each written and committed on its own under its number; committed ones are passed over. Returns all of them.

        For inputs whose cleaned rows are wanted as they come, or whose run may
        be ended on the way: a run that begins again goes on with the first part
        that isn't committed. Steps see a part's rows only.
        """
        own = df.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(parts)))
        done, schema = set(tables.batches()), None
        for part in range(parts):
            cleaned = self.run(own.where(F.col("_part") == part).drop("_part"), **how)
            schema = cleaned.schema
            if part not in done:
                tables.write(cleaned, "cleaned", part)
                tables.commit(part)
        return tables.read("cleaned", schema, batches=range(parts))


@dataclass
class Metrics:
    """Named aggregate expressions with their direction."""

    entries: dict[str, tuple[Callable[[], Column], bool]] = field(default_factory=dict)

    def register(self, name: str, *, higher_is_better: bool = True) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
        def take(f: Callable[[], Column]) -> Callable[[], Column]:
            self.entries[name] = (f, higher_is_better)
            return f

        return take

    def evaluate(self, df: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
        """All metrics of each group in one pass."""
        return df.groupBy(*keys).agg(*[f().alias(n) for n, (f, _) in self.entries.items()])

    def best(self, results: DataFrame, key: str, metric: str) -> DataFrame:
        """The group with the best value; ties by key."""
        order = F.col(metric).desc() if self.entries[metric][1] else F.col(metric).asc()
        return results.orderBy(order, key).limit(1)


@dataclass
class Labels:
    """Names of types in one vocabulary for names in another."""

    table: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, label: str) -> None:
        if self.table.get(name, label) != label:
            raise ValueError(f"{name} is {self.table[name]} already")
        self.table[name] = label

    def rename(self, df: DataFrame, column: str, *, drop_unknown: bool = True) -> DataFrame:
        if not self.table:
            return df.limit(0) if drop_unknown else df
        found = F.create_map(*[F.lit(x) for pair in sorted(self.table.items()) for x in pair])[F.col(column)]
        out = df.withColumn(column, found if drop_unknown else F.coalesce(found, F.col(column)))
        return out.where(F.col(column).isNotNull()) if drop_unknown else out


@dataclass
class Methods:
    """Named methods of matching with how sure each is; later names may be added, none changed."""

    table: dict[str, float] = field(default_factory=dict)

    def register(self, name: str, confidence: float) -> None:
        if not 0 <= confidence <= 1:
            raise ValueError("confidence must be from 0 to 1")
        if self.table.get(name, confidence) != confidence:
            raise ValueError(f"{name} has {self.table[name]} already")
        self.table[name] = confidence

    def confidence(self, method: Column) -> Column:
        """The confidence of a method's name; null for unknown ones and null."""
        if not self.table:
            return F.lit(None).cast("double")
        return F.create_map(*[F.lit(x) for pair in sorted(self.table.items()) for x in pair])[method]


@dataclass
class Alerts:
    """Callbacks by event; watch() tells them of a stream's progress and end."""

    calls: dict[str, list[Callable[[dict], None]]] = field(default_factory=dict)

    def register(self, event: str, call: Callable[[dict], None]) -> None:
        self.calls.setdefault(event, []).append(call)

    def tell(self, event: str, details: dict) -> int:
        """Calls all callbacks of an event, in order; one that fails doesn't keep the others from being called. Returns how many failed."""
        failed = 0
        for call in self.calls.get(event, []):
            try:
                call(details)
            except Exception:
                failed += 1
        return failed

    def watch(self, spark: SparkSession) -> StreamingQueryListener:
        """Events progress (id, batch, rows) and terminated (id, error) of the session's streams; remove the listener to end it."""
        alerts = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:
                alerts.tell("started", {"id": str(event.id)})

            def onQueryProgress(self, event) -> None:
                p = event.progress
                alerts.tell("progress", {"id": str(p.id), "batch": p.batchId, "rows": p.numInputRows})

            def onQueryIdle(self, event) -> None:
                pass

            def onQueryTerminated(self, event) -> None:
                alerts.tell("terminated", {"id": str(event.id), "error": event.exception})

        listener = Listener()
        spark.streams.addListener(listener)
        return listener


@dataclass
class Loaders:
    """Sources by name: how to read one, and how its rows become nodes and edges."""

    table: dict[str, tuple[Callable[[SparkSession, str], DataFrame], Callable[[DataFrame], tuple[DataFrame, DataFrame]]]] = field(default_factory=dict)

    def register(self, name: str, read: Callable[[SparkSession, str], DataFrame], to_graph: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> None:
        if name in self.table:
            raise ValueError(f"loader {name} is there already")
        self.table[name] = read, to_graph

    def load(self, spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the named sources together; an unknown name raises KeyError."""
        graphs = [self.table[name][1](self.table[name][0](spark, path)) for name, path in sorted(paths.items())]
        return reduce(DataFrame.unionByName, [n for n, _ in graphs]), reduce(DataFrame.unionByName, [e for _, e in graphs])


def converted(df: DataFrame, column: str, out: str, convert: Callable[[str], str | None]) -> DataFrame:
    """df with out filled, where it is null, by a converter of column's strings that is called on the executors; what fails or gives None stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            try:
                return None if v is None else convert(v)
            except Exception:
                return None

        return values.map(one)

    return df.withColumn(out, F.when(F.col(out).isNotNull(), F.col(out)).otherwise(run(F.when(F.col(out).isNull(), F.col(column)))))


#: Logical operators that change something.
_WRITES = ("Command", "InsertInto", "CreateTable", "CreateView", "Drop", "Delete", "Update", "Merge", "Append", "Overwrite", "Set", "Cache", "Refresh", "Alter", "Truncate")


def read_only_sql(spark: SparkSession, query: str, *, longest: int = 8192) -> DataFrame:
    """The result of one query that only reads; commands and texts over the limit raise ValueError before anything runs."""
    if len(query.encode()) > longest:
        raise ValueError("query too long")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    names = [plan.apply(i).nodeName() for i in range(64) if plan.apply(i) is not None]
    if any(n.startswith(w) or n.endswith("Command") for n in names for w in _WRITES):
        raise ValueError("only queries are allowed")
    return spark.sql(query)
