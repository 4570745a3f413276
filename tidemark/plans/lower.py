"""Lowering of frames to KeyedFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.errors import QueryError
from tidemark.operators.frame import KeyedFrame
from tidemark.plans import ast
from tidemark.plans.filters import predicate_column

Resolve = Callable[[ast.TableRef], KeyedFrame]


@dataclass(frozen=True)
class Options:
    precedence: str = "right"  # or "sql"
    string_order: str = "shortlex"  # or "lexical"


def _source(source: ast.TableRef | ast.Frame, resolve: Resolve, options: Options) -> KeyedFrame:
    return resolve(source) if isinstance(source, ast.TableRef) else lower_frame(source, resolve, options)


def _filtered(frame: KeyedFrame, where: ast.Predicate | None, options: Options) -> KeyedFrame:
    if where is None:
        return frame
    return frame.filter(predicate_column(where, list(frame.fields), options.precedence, options.string_order))


def lower_frame(node: ast.Frame, resolve: Resolve, options: Options = Options()) -> KeyedFrame:
    match node:
        case ast.Select(fields, source, where):
            return _filtered(_source(source, resolve, options), where, options).project(fields)
        case ast.Combine(op, left, right):
            one, two = lower_frame(left, resolve, options), lower_frame(right, resolve, options)
            return {"JOIN": one.join, "UNION": one.union, "INTERSECTION": one.intersection}[op](two)
    raise QueryError(f"Not a frame: {node}")


def lower_count(node: ast.Count, resolve: Resolve, options: Options = Options()) -> DataFrame:
    return _filtered(_source(node.source, resolve, options), node.where, options).counted()
