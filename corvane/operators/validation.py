"""Extractions checked against a nested schema: what is wrong with each, by path and reason."""

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

from corvane.functions.text import quote_offset
from corvane.session import settle
from corvane.sources.providers import retry_delay

FAULT = "array<struct<path:string,reason:string>>"


@dataclass(frozen=True)
class Shape:
    """What a value has to be: text, integer, number, boolean, list (of `items`) or object (of `fields`)."""

    kind: str
    required: bool = False
    one_of: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None
    items: "Shape | None" = None
    fields: dict[str, "Shape"] = field(default_factory=dict)
    #: Whether an object may have other fields.
    open: bool = True

    def type(self) -> DataType:
        """The type of a valid value's column."""
        plain = {"text": StringType(), "integer": LongType(), "number": DoubleType(), "boolean": BooleanType()}
        if self.kind == "list":
            return ArrayType(self.items.type())
        return plain.get(self.kind) or reduce(lambda s, f: s.add(f[0], f[1].type()), self.fields.items(), StructType())

    def json_schema(self) -> dict:
        """The same as a JSON schema, for a provider."""
        names = {"text": "string", "list": "array"}
        out: dict = {"type": names.get(self.kind, self.kind)}
        if self.one_of:
            out["enum"] = list(self.one_of)
        if self.kind == "list":
            out["items"] = self.items.json_schema()
        if self.kind == "object":
            out |= {"properties": {k: f.json_schema() for k, f in self.fields.items()}, "required": [k for k, f in self.fields.items() if f.required]}
        return out | {k: v for k, v in (("minimum", self.least), ("maximum", self.most)) if v is not None}


def shape_of(ddl: str, required: tuple[str, ...] = ()) -> Shape:
    """An object's shape from column definitions; of its fields some are required."""
    kinds = {StringType: "text", IntegerType: "integer", LongType: "integer", DoubleType: "number", BooleanType: "boolean"}

    def of(kind: DataType, must: bool = False) -> Shape:
        if isinstance(kind, ArrayType):
            return Shape("list", must, items=of(kind.elementType))
        if isinstance(kind, StructType):
            return Shape("object", must, fields={f.name: of(f.dataType, f.name in required) for f in kind})
        return Shape(kinds[type(kind)], must)

    return of(StructType.fromDDL(ddl))


# What each kind is called in a reason.
_CALLED = {"text": "not a text", "integer": "not a whole number", "number": "not a number", "boolean": "not true or false", "list": "not a list", "object": "not an object"}


def _none() -> Column:
    return F.array().cast(FAULT)


def _fault(path: Column, reason: str, wrong: Column) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(reason).alias("reason")))).otherwise(_none())


def _is(value: Column, kind: str) -> Column:
    named = F.schema_of_variant(value)
    if kind == "list":
        return named.startswith("ARRAY")
    if kind == "object":
        return named.startswith("OBJECT")
    if kind == "text":
        return named == "STRING"
    if kind == "boolean":
        return named == "BOOLEAN"
    number = F.try_variant_get(value, "$", "double")
    usable = number.isNotNull() & (named != "BOOLEAN") & ~F.isnan(number)
    return usable if kind == "number" else usable & (number == F.floor(number))


def _faults(value: Column, shape: Shape, path: Column, required: bool) -> Column:
    """Faults of a variant: null for a value that isn't there."""
    absent = value.isNull() | F.is_variant_null(value)
    right = _is(value, shape.kind)
    inner = [_none()]
    if shape.kind == "object":
        inner += [_faults(F.try_variant_get(value, f"$.{name}", "variant"), part, F.concat_ws(".", F.nullif(path, F.lit("")), F.lit(name)), part.required) for name, part in shape.fields.items()]
        if not shape.open:
            others = F.array_except(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), F.array(*[F.lit(n) for n in shape.fields]).cast("array<string>"))
            inner.append(F.transform(F.array_sort(others), lambda n: F.struct(F.concat_ws(".", F.nullif(path, F.lit("")), n).alias("path"), F.lit("unknown field").alias("reason"))))
    if shape.kind == "list":
        each = lambda v, i: _faults(v, shape.items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), True)
        inner.append(F.flatten(F.transform(F.try_variant_get(value, "$", "array<variant>"), each)))
    if shape.one_of:
        inner.append(_fault(path, "not one of " + ", ".join(shape.one_of), ~F.try_variant_get(value, "$", "string").isin(*shape.one_of)))
    number = F.try_variant_get(value, "$", "double")
    if shape.least is not None:
        inner.append(_fault(path, f"less than {shape.least:g}", number < shape.least))
    if shape.most is not None:
        inner.append(_fault(path, f"more than {shape.most:g}", number > shape.most))
    whole = F.concat(*inner) if len(inner) > 1 else inner[0]
    return F.when(absent, _fault(path, "missing", F.lit(required))).when(~F.coalesce(right, F.lit(False)), _fault(path, _CALLED[shape.kind], F.lit(True))).otherwise(whole)


def violations(text: Column, shape: Shape) -> Column:
    """array of (path, reason): all that is wrong with a JSON text, empty if nothing is. Whole numbers may be written as 5.0, and
    numbers as texts; null is the same as missing. A text that isn't JSON, or null, has one fault without a path."""
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNull(), _fault(F.lit(""), "not JSON", F.lit(True))).otherwise(_faults(parsed, shape, F.lit(""), True))


def typed(text: Column, shape: Shape) -> Column:
    """The value of a JSON text that has no violations, as columns."""
    return F.try_variant_get(F.try_parse_json(text), "$", shape.type().simpleString())


def checked(rows: DataFrame, json_col: str, shape: Shape, text_col: str | None = None, quote: str = "source_quote") -> DataFrame:
    """The rows with `value`, typed, and `violations`. With a text column, a value's quote has to stand in it, white space aside;
    the value of rows with violations is null."""
    found = rows.withColumn("violations", violations(F.col(json_col), shape)).withColumn("value", F.when(F.size("violations") == 0, typed(F.col(json_col), shape)))
    if text_col is None or quote not in shape.fields:
        return found
    said = F.nullif(F.btrim(F.col("value")[quote]), F.lit(""))
    lost = F.array(F.struct(F.lit(quote).alias("path"), F.lit("not in the source").alias("reason")))
    found = found.withColumn("violations", F.when(said.isNotNull() & quote_offset(said, F.col(text_col)).isNull(), lost).otherwise(F.col("violations")))
    return found.withColumn("value", F.when(F.size("violations") == 0, F.col("value")))


def valid_only(found: DataFrame) -> DataFrame:
    """Of checked rows those without violations."""
    return found.where(F.size("violations") == 0).drop("violations")


def all_valid(found: DataFrame) -> DataFrame:
    """Checked rows, of which none may have a violation: reading one fails with its first path and reason."""
    first = F.get("violations", F.lit(0))
    message = F.concat(F.lit("extraction isn't valid: "), first["path"], F.lit(": "), first["reason"])
    return found.withColumn("value", F.when(F.size("violations") > 0, F.raise_error(message).cast(found.schema["value"].dataType)).otherwise(F.col("value"))).drop("violations")


#: text, JSON schema, instructions and the most items to give, to the items as a JSON list; None where there are none.
Extractor = Callable[[str, str, str, int], str | None]


def extracted(docs: DataFrame, extract: Extractor, shape: Shape, instructions: str = "", most: int = 20, id_col: str = "doc_id", text_col: str = "text", tries: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, place, item, violations, value, error): what a provider that a caller passes in, such as a language model, extracts
    from each text, checked one by one; at most `most` items of a text. A call that raises OSError is tried again; what fails to
    the end is a row with its error, as is an answer that isn't a list. Null texts and texts where nothing is found have no
    rows. Calls are made once: their answers are settled before they are read."""
    kind, schema = docs.schema[id_col].dataType.simpleString(), json.dumps(shape.json_schema())

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for text in batch["text"]:
                answer, error = None, None
                for k in range(1, tries + 1):
                    try:
                        answer, error = extract(text, schema, instructions, most), None
                        break
                    except OSError as problem:
                        error = str(problem)
                        if k < tries:
                            pause(retry_delay(k))
                answers.append(answer)
                errors.append(error)
            yield batch.assign(answer=pd.Series(answers, index=batch.index, dtype=object), error=pd.Series(errors, index=batch.index, dtype=object))

    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    said = settle(asked.mapInPandas(ask, f"id {kind}, text string, answer string, error string").where("answer IS NOT NULL OR error IS NOT NULL"), "answers")
    items = F.try_variant_get(F.try_parse_json("answer"), "$", "array<variant>")
    error = F.coalesce("error", F.when(items.isNull(), "the answer isn't a list"))
    whole = said.withColumns({"error": error, "items": F.transform(F.slice(items, 1, most), lambda x: F.to_json(x))})
    each = whole.where("error IS NULL").select("id", "text", F.posexplode("items").alias("place", "item"), "error")
    failed = whole.where("error IS NOT NULL").select("id", "text", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("item"), "error")
    good = checked(each, "item", shape, "text").select("id", "place", "item", "violations", "value", "error")
    bad = failed.select("id", "place", "item", F.lit(None).cast(FAULT).alias("violations"), F.lit(None).cast(good.schema["value"].dataType).alias("value"), "error")
    return good.unionByName(bad).withColumnRenamed("id", id_col)
