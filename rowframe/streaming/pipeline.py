"""A lazy pipeline of row steps over a file, a frame or a folder that grows.

A batch source gives a plan that runs once; a watched folder is read by Structured Streaming, and run() takes everything
there is (``availableNow``) through the same steps. Steps are DataFrame expressions, so they fuse into one stage; memory
is bounded by Spark's iterators rather than by a buffer of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import IO, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rowframe.errors import RowFrameError
from rowframe.frame import Frame
from rowframe.operators.base import Columns
from rowframe.sources.dialect import Dialect
from rowframe.sources.reader import from_file
from rowframe.sources.writer import lines_of, write_file

Step = Callable[[Frame], Frame]


@dataclass(frozen=True)
class Pipeline:
    """Immutable: each step returns a new pipeline."""

    source: Callable[[], Frame] | None = None
    stream: Callable[[], DataFrame] | None = None
    steps: tuple[Step, ...] = ()
    sink: tuple[str, Any] | None = None

    # ---- sources

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, dialect: Dialect | None = None, **options: Any) -> Pipeline:
        """A file, opened only when the pipeline runs; options as for reading (header map, casts, schema)."""
        return cls(source=lambda: from_file(spark, path, dialect, **options))

    @classmethod
    def from_frame(cls, frame: Frame) -> Pipeline:
        return cls(source=lambda: frame)

    @classmethod
    def watch(cls, spark: SparkSession, folder: str, schema: T.StructType | str, dialect: Dialect | None = None, files_per_trigger: int | None = None) -> Pipeline:
        """Files dropped into a folder, each read once, in micro-batches of ``files_per_trigger`` files."""
        own = (dialect or Dialect()).reader_options()
        reader = spark.readStream.schema(schema).options(**own).option("header", True)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return cls(stream=lambda: reader.csv(folder))

    # ---- steps

    def _then(self, step: Step) -> Pipeline:
        return replace(self, steps=(*self.steps, step))

    def filter(self, condition: Any) -> Pipeline:
        return self._then(lambda f: f.find_rows_where(condition))

    def map(self, fn: Callable[[Columns], Any] | Any) -> Pipeline:
        """Rows of a new shape, as Frame.transform()."""
        return self._then(lambda f: f.transform(fn))

    def add_column(self, name: str, value: Any) -> Pipeline:
        return self._then(lambda f: f.add_column(name, value))

    def through(self, step: Step) -> Pipeline:
        """Any step from frame to frame."""
        return self._then(step)

    # ---- ends

    def prepare_collect(self) -> Pipeline:
        return replace(self, sink=("collect", None))

    def prepare_to_file(self, path: str, **options: Any) -> Pipeline:
        """One file with header and byte order mark by default."""
        return replace(self, sink=("file", (path, {"bom": True, "suffix": False} | options)))

    def prepare_for_each(self, fn: Callable[[dict[str, Any]], Any]) -> Pipeline:
        return replace(self, sink=("each", fn))

    def prepare_pipe_to(self, target: IO[str]) -> Pipeline:
        return replace(self, sink=("pipe", target))

    def frame(self) -> Frame:
        """The plan over a batch source."""
        if self.source is None:
            raise RowFrameError("a watched folder has no single frame; use run()")
        out = self.source()
        for step in self.steps:
            out = step(out)
        return out

    def run(self, checkpoint: str | None = None) -> Frame | None:
        """Runs the pipeline into its end; a collected result comes back as a frame."""
        if self.stream is not None:
            return self._run_stream(checkpoint)
        kind, target = self.sink or ("none", None)
        out = self.frame()
        if kind == "collect":
            return Frame(out._df.cache(), out._keys, out.preamble)
        self._deliver(out, kind, target)
        return None

    def _deliver(self, out: Frame, kind: str, target: Any) -> None:
        if kind == "file":
            write_file(out, target[0], **target[1])
        elif kind == "each":
            out.for_each(target)
        elif kind == "pipe":
            for line in lines_of(out):
                target.write(line)
        else:
            out._df.write.format("noop").mode("overwrite").save()

    def _run_stream(self, checkpoint: str | None) -> Frame | None:
        """All files there are, by foreachBatch; batches reach the end in their order."""
        kind, target = self.sink or ("none", None)
        if kind == "file":
            raise RowFrameError("a watched folder ends in a folder: use run_to_folder()")
        gathered: list[DataFrame] = []

        def batch(df: DataFrame, _: int) -> None:
            out = Frame(df)
            for step in self.steps:
                out = step(out)
            if kind == "collect":
                own = out.df.persist()
                own.count()
                gathered.append(own)
            else:
                self._deliver(out, kind, target)

        writer = self.stream().writeStream.foreachBatch(batch).trigger(availableNow=True)
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        writer.start().awaitTermination()
        if kind != "collect":
            return None
        if not gathered:
            return Frame(self.stream().sparkSession.createDataFrame([], self.stream().schema))
        out = gathered[0]
        for more in gathered[1:]:
            out = out.unionByName(more)
        return Frame(out)

    def run_to_folder(self, path: str, checkpoint: str, fmt: str = "csv") -> None:
        """A watched folder through the steps into a folder of files, each input file exactly once."""
        out = Frame(self.stream())
        for step in self.steps:
            out = step(out)
        out.df.writeStream.format(fmt).options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def __iter__(self) -> Iterator[dict[str, Any]]:
        return iter(self.frame())


def transformer(fn: Callable[[Frame], Frame] | Any) -> Callable[[DataFrame], DataFrame]:
    """A row step for DataFrame.transform()."""
    return lambda df: (fn(Frame.from_df(df)) if callable(fn) else Frame.from_df(df).transform(fn)).df
