"""User functions as callable tools: registration from annotations and dispatch by name."""

from __future__ import annotations

import inspect
import json
import types as pytypes
import typing
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# JSON type names, their Python types and Spark types.
JSON_TYPES = {
    "string": (str, T.StringType()),
    "integer": (int, T.LongType()),
    "number": (float, T.DoubleType()),
    "boolean": (bool, T.BooleanType()),
    "object": (dict, T.MapType(T.StringType(), T.StringType())),
    "array": (list, T.ArrayType(T.StringType())),
}


def _json_type(annotation) -> str:
    for arg in typing.get_args(annotation) if isinstance(annotation, pytypes.UnionType) or typing.get_origin(annotation) is typing.Union else ():
        if arg is not type(None):
            annotation = arg
    base = typing.get_origin(annotation) or annotation
    return next((name for name, (py, _) in JSON_TYPES.items() if py is base), "string")


def describe(fn: Callable) -> dict:
    """Name, description and parameters of a documented, public function."""
    if fn.__name__.startswith("_") or not inspect.getdoc(fn):
        raise ValueError(f"{fn.__name__} needs a public name and a docstring")
    hints = typing.get_type_hints(fn)
    params = {n: {"type": _json_type(hints.get(n, str)), "required": p.default is inspect.Parameter.empty}
              for n, p in inspect.signature(fn).parameters.items()}
    return {"name": fn.__name__, "description": inspect.getdoc(fn), "params": params, "returns": _json_type(hints.get("return", str))}


def call(fn: Callable, args: dict):
    """Call with arguments by name; None for an optional parameter means its default."""
    sig = inspect.signature(fn).parameters
    return fn(**{k: v for k, v in args.items() if v is not None or sig[k].default is inspect.Parameter.empty})


def as_udf(fn: Callable):
    """Arrow-batched column function typed from the annotations."""
    info = describe(fn)
    names = list(info["params"])

    def run(*columns: pd.Series) -> pd.Series:
        clean = [c.astype(object).where(c.notna(), None) for c in columns]
        return pd.Series([call(fn, dict(zip(names, row))) for row in zip(*clean)])
    # The batch function takes one series per parameter, whatever their number.
    run.__signature__ = inspect.Signature([inspect.Parameter(n, inspect.Parameter.POSITIONAL_OR_KEYWORD, annotation=pd.Series) for n in names], return_annotation=pd.Series)
    run.__annotations__ = {**{n: pd.Series for n in names}, "return": pd.Series}
    return F.pandas_udf(run, JSON_TYPES[info["returns"]][1], F.PandasUDFType.SCALAR)


def register(spark: SparkSession, fn: Callable) -> dict:
    """Make a function callable from SQL under its own name."""
    spark.udf.register(fn.__name__, as_udf(fn))
    return describe(fn)


def dispatch(functions: list[Callable], name: Column, args: Column) -> Column:
    """Call by name with JSON arguments: struct<value, error>; failures become the error text."""
    table = {f.__name__: f for f in functions}

    def one(n: str, a: str) -> tuple[str | None, str | None]:
        fn = table.get(n)
        if fn is None:
            return None, f"未找到工具 '{n}'，请先用 tool_search / mcp_search 检索"
        try:
            v = call(fn, json.loads(a or "{}"))
            return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str), None
        except Exception as e:  # noqa: BLE001 - a failing tool must not fail the job
            return None, f"调用工具 '{n}' 失败: {e}"

    def run(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(n, a) for n, a in zip(names, texts)], columns=["value", "error"])
    run.__annotations__ = {"names": pd.Series, "texts": pd.Series, "return": pd.DataFrame}
    out = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])
    return F.pandas_udf(run, out)(name, args)
