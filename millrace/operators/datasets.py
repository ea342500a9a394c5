"""Named datasets: publish a result under a name, refer to it from later steps and from SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.params import merged_parameters

Outputs = DataFrame | Mapping[str, DataFrame]


class Datasets:
    """Names for DataFrames. Nothing runs here: a reference is the plan of the published frame.

    SQL can use a published name. A step with several outputs is published as ``name.output`` for each of
    them. Several registries may use the same names in one session: each one's SQL sees its own frames.
    """

    def __init__(self, spark: SparkSession, ctx: Mapping[str, Any] | None = None):
        self.spark = spark
        self.ctx = dict(ctx or {})
        self._frames: dict[str, DataFrame] = {}
        self._outputs: dict[str, list[str]] = {}

    def publish(self, name: str, result: Outputs) -> Outputs:
        """Publish one frame, or a mapping of named outputs. The last publication of a name wins."""
        if result is None:
            raise ValueError(f"step {name!r} produced no output")
        outputs = {name: result} if isinstance(result, DataFrame) else {
            f"{name}.{output}": frame for output, frame in result.items()
        }
        if not outputs:
            raise ValueError(f"step {name!r} produced no output")
        for full_name, frame in outputs.items():
            if not isinstance(frame, DataFrame):
                raise ValueError(f"output {full_name!r} must be a DataFrame, not {type(frame).__name__}")
        # Earlier outputs of the same step go away as a whole: a re-run may have other outputs.
        for old in self._outputs.pop(name, []):
            del self._frames[old]
            self.spark.catalog.dropTempView(f"`{old}`")
        self._outputs[name] = list(outputs)
        for full_name, frame in outputs.items():
            self._frames[full_name] = frame
            frame.createOrReplaceTempView(f"`{full_name}`")
        return result

    def ref(self, name: str, output: str | None = None) -> DataFrame:
        full_name = name if output is None else f"{name}.{output}"
        try:
            return self._frames[full_name]
        except KeyError:
            several = self._outputs.get(full_name)
            hint = f"; it has the outputs {several}" if several else ""
            raise ValueError(f"no dataset named {full_name!r} was published{hint}") from None

    def step(self, name: str, fn: Callable[..., Outputs], *inputs: str, require_rows: bool = False) -> Outputs:
        """Publish ``fn(*inputs)``. ``require_rows`` also fails on an empty result, at the cost of a job."""
        result = self.publish(name, fn(*(self.ref(i) for i in inputs)))
        if require_rows:
            for frame in [result] if isinstance(result, DataFrame) else result.values():
                if frame.isEmpty():
                    raise ValueError(f"step {name!r} produced no rows")
        return result

    def sql(self, text: str, params: Mapping[str, Any] | None = None, **frames: DataFrame) -> DataFrame:
        """Run SQL over published names, ``{frame}`` placeholders and ``:name`` parameters."""
        args = merged_parameters(self.ctx, params)
        used = {k: v for k, v in args.items() if f":{k}" in text}
        # Views belong to the session, and another registry may have taken a name since. A plan is
        # bound to its frames when it is made, so they only have to be right now.
        for name, frame in self._frames.items():
            if name.split(".")[0] in text:
                frame.createOrReplaceTempView(f"`{name}`")
        return self.spark.sql(text, args=used or None, **frames)

    def param(self, key: str, default: Any = None) -> Any:
        return self.ctx.get(key, default)
