"""Mapped sources: records from rows of sheets, by a declarative specification."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.context import BadArgument
from tallyspark.functions.transforms import apply_transforms, fold_key, trim


@dataclass(frozen=True)
class Lookup:
    """The value of the first row of another sheet whose transformed key is that of match_on; a blank key finds nothing."""

    sheet: str
    key: str
    value: str
    match_on: str
    key_transforms: tuple = ("fold_key",)
    match_transforms: tuple = ("fold_key",)


@dataclass(frozen=True)
class Field:
    """Where a value comes from (one of group_key, constant, column, row_number, concat, lookup) and what is done to it."""

    column: str | None = None
    constant: object = None
    concat: tuple[Field, ...] = ()
    separator: str = ""
    lookup: Lookup | None = None
    row_number: bool = False
    group_key: bool = False
    transforms: tuple = ()

    @staticmethod
    def parse(definition: object, where: str) -> Field:
        """A definition, or a bare column name; errors say where in the specification they are."""
        if not isinstance(definition, dict):
            return Field(column=str(definition))
        found = [k for k in SOURCES if k in definition]
        if len(found) != 1:
            raise BadArgument(f"{where}: {'no source' if not found else 'more than one source'}; there are {', '.join(SOURCES)}")
        given = dict(definition)
        if "concat" in given:
            given["concat"] = tuple(Field.parse(d, f"{where}.concat") for d in given["concat"])
        try:
            if "lookup" in given:
                given["lookup"] = Lookup(**_frozen(given["lookup"]))
            return Field(**_frozen(given))
        except TypeError as error:
            raise BadArgument(f"{where}: {error}") from None


#: Fixed: the sources of a value.
SOURCES = ("group_key", "constant", "column", "row_number", "concat", "lookup")
_ENTITY = {"from", "fields", "skip_when_blank", "group_by", "constant", "lines", "distinct_by"}


def _frozen(d: dict) -> dict:
    return {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}


@dataclass(frozen=True)
class EntitySpec:
    fields: dict[str, Field]
    skip_when_blank: tuple[str, ...] = ()
    group_by: Field | None = None
    sheet: str | None = None
    constants: tuple[dict, ...] = ()
    lines: dict[str, Field] = field(default_factory=dict)
    distinct_by: Field | None = None


@dataclass(frozen=True)
class MappingSpec:
    entities: dict[str, EntitySpec] = field(default_factory=dict)
    source: str = ""
    display_name: str = ""
    workbook: str = ""
    capabilities: dict[str, bool] = field(default_factory=dict)
    settings: dict[str, object] = field(default_factory=dict)
    sheets: dict[str, str] = field(default_factory=dict)
    notes: tuple[str, ...] = ()

    @staticmethod
    def parse(spec: dict, **others) -> MappingSpec:
        """Of the entities' definitions."""
        entities = {}
        for name, e in spec.items():
            unknown = set(e) - _ENTITY
            if unknown or not {"fields", "constant"} & set(e):
                raise BadArgument(f"{name}: {'unknown key ' + sorted(unknown)[0] if unknown else 'no fields'}")
            parsed = lambda d, at: {f: Field.parse(x, f"{at}.{f}") for f, x in (d or {}).items()}
            by = {k: Field.parse(e[k], f"{name}.{k}") for k in ("group_by", "distinct_by") if e.get(k)}
            lines = parsed((e.get("lines") or {}).get("fields"), f"{name}.lines")
            entities[name] = EntitySpec(parsed(e.get("fields"), name), tuple(e.get("skip_when_blank") or ()), sheet=e.get("from"), constants=tuple(e.get("constant") or ()), lines=lines, **by)
        return MappingSpec(entities, **others)

    @staticmethod
    def load(path: str) -> MappingSpec:
        """Of a YAML file with source, workbook, capabilities, entities, and perhaps display_name, settings, sheets and notes.

        `at_time` without arguments takes the settings' assumed_time_of_day (12:00) and timezone (UTC).
        """
        import yaml

        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        for section in ("source", "workbook", "capabilities", "entities"):
            if section not in raw:
                raise BadArgument(f"{Path(path).name}: no {section!r}")
        settings, sheets = dict(raw.get("settings") or {}), {k: v["match"] for k, v in (raw.get("sheets") or {}).items()}
        at = {"at_time": {"at": str(settings.get("assumed_time_of_day", "12:00")), "timezone": str(settings.get("timezone", "UTC"))}}

        def timed(d):
            if isinstance(d, dict):
                return {k: [at if s == "at_time" else s for s in v or ()] if k.endswith("transforms") else timed(v) for k, v in d.items()}
            return [timed(x) for x in d] if isinstance(d, list) else d

        spec = MappingSpec.parse(
            {name: timed(e or {}) for name, e in raw["entities"].items()}, source=raw["source"], display_name=raw.get("display_name", raw["source"]), workbook=str(raw["workbook"]),
            capabilities=dict(raw["capabilities"]), settings=settings, sheets=sheets, notes=tuple(raw.get("notes") or ()),
        )
        for name, e in spec.entities.items():
            if e.sheet and e.sheet not in sheets:
                raise BadArgument(f"{name}: there is no sheet {e.sheet!r}; there are {', '.join(sheets)}")
        return spec


def usable_rows(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    for c in columns:
        rows = rows.filter(F.col(c).isNotNull() & (trim(F.col(c)) != ""))
    return rows


def group_key(rows: DataFrame, column: str | Field, sheet: str = "sheet", row: str = "row") -> DataFrame:
    """Rows with the column group_key: the column folded, or a field's value after its transforms; the row itself where that is blank."""
    key = fold_key(F.col(column)) if isinstance(column, str) else apply_transforms(F.col(column.column), list(column.transforms), "group_by").cast("string")
    return rows.withColumn("group_key", F.when(key != "", key).otherwise(F.concat_ws(":", F.col(sheet), F.col(row).cast("string"))))


def modal_row(rows: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Per group and column the commonest value that is not blank; ties go to the one seen first."""
    out = rows.select(key).distinct()
    for c in columns:
        counts = usable_rows(rows, (c,)).groupBy(key, c).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
        best = counts.groupBy(key).agg(F.max_by(c, F.struct("n", (-F.col("seen")).alias("s"))).alias(c))
        out = out.join(best, key, "left")
    return out


def lookup(rows: DataFrame, column: str, table: DataFrame, key: str, value: str, order: str, into: str, key_steps: tuple = ("fold_key",), match_steps: tuple = ("fold_key",)) -> DataFrame:
    """Rows with the value of the first row of a table whose transformed key, if not blank, is theirs."""
    right = table.select(apply_transforms(F.col(key), list(key_steps), key).cast("string").alias("__k"), F.col(value).alias("__v"), F.col(order).alias("__o"))
    right = right.filter("__k <> ''").groupBy("__k").agg(F.min_by("__v", "__o").alias(into))
    asked = apply_transforms(F.col(column), list(match_steps), column).cast("string")
    return rows.withColumn("__key", asked).join(right, F.col("__key") == F.col("__k"), "left").drop("__key", "__k")


def _lookups(f: Field) -> list[Lookup]:
    return [f.lookup] if f.lookup else [x for part in f.concat for x in _lookups(part)]


def records(rows: DataFrame, spec: EntitySpec, sheet: str = "sheet", row: str = "row", sheets: dict[str, DataFrame] | None = None) -> DataFrame:
    """A record for each usable row; sheets are those that lookups read, by name, with the same column row."""
    rows = usable_rows(rows, spec.skip_when_blank)
    if spec.group_by:
        rows = group_key(rows, spec.group_by, sheet, row)
    found: list[Lookup] = []
    for x in [x for f in spec.fields.values() for x in _lookups(f)]:
        if x in found:
            continue
        if x.sheet not in (sheets or {}):
            raise BadArgument(f"a lookup reads the sheet {x.sheet!r}, which is not given")
        rows = lookup(rows, x.match_on, sheets[x.sheet], x.key, x.value, row, f"__found_{len(found)}", x.key_transforms, x.match_transforms)
        found.append(x)

    def value(name: str, f: Field) -> Column:
        if f.group_key:
            c = F.col("group_key")
        elif f.row_number:
            c = F.concat_ws(":", F.col(sheet), F.col(row).cast("string"))
        elif f.concat:
            c = F.array_join(F.array(*[value(name, part).cast("string") for part in f.concat]), f.separator, "")
        elif f.lookup:
            c = F.col(f"__found_{found.index(f.lookup)}")
        elif f.column:
            c = F.col(f.column)
        else:
            c = F.lit(f.constant)
        return apply_transforms(c, list(f.transforms), name)

    return rows.select(*[value(n, f).alias(n) for n, f in spec.fields.items()])


def line_records(rows: DataFrame, spec: EntitySpec, **others) -> DataFrame:
    """A record for each line of grouped rows, by the entity's lines."""
    return records(rows, EntitySpec(spec.lines, spec.skip_when_blank, spec.group_by), **others)


def distinct_rows(rows: DataFrame, spec: EntitySpec, sheet: str = "sheet", row: str = "row") -> DataFrame:
    """A row for each key of distinct_by, with the commonest value of each column and the first sheet and row; a row with a blank key stands alone.

    records() of these are the entity's.
    """
    kept = group_key(usable_rows(rows, spec.skip_when_blank), spec.distinct_by, sheet, row)
    names = [c for c in rows.columns if c not in (sheet, row)]
    first = kept.groupBy("group_key").agg(F.min_by(sheet, row).alias(sheet), F.min(row).alias(row))
    return modal_row(kept, "group_key", names, row).join(first, "group_key")


def orders_from_lines(lines: DataFrame, key: str = "group_key") -> DataFrame:
    """Orders of grouped lines (quantity, price, discount, line_no): subtotal of quantity by price, total less discounts, line ids key:index."""
    index = F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1
    lines = lines.withColumn("line_index", index).withColumn("line_id", F.concat_ws(":", F.col(key), F.col("line_index").cast("string")))
    sums = lines.groupBy(key).agg(F.sum((F.col("quantity") * F.col("price")).cast("decimal(24,4)")).alias("subtotal"), F.sum("discount").alias("discount"), F.array_sort(F.collect_list(F.struct("line_index", "line_id")))["line_id"].alias("lines"))
    return sums.select(key, F.round("subtotal", 2).cast("double").alias("subtotal"), F.round("discount", 2).cast("double").alias("discount"), F.round(F.col("subtotal") - F.col("discount"), 2).cast("double").alias("total"), F.size("lines").cast("long").alias("n_lines"), "lines")
