"""Nested JSON: dotted series, dimensional cubes and feature attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelbook.functions import let
from parcelbook.functions.keys import dotted_parts
from parcelbook.functions.numbers import finite

SERIES = "array<struct<Nombre:string,COD:string,Data:array<struct<Anyo:int,FK_Periodo:int,Valor:double>>>>"


def series_rows(df: DataFrame, payload: str, keep: list[str], keys: list[str]) -> DataFrame:
    """One row per data point of every series whose dotted name ends in ``keep``."""
    series = df.select(
        *keys, F.explode(F.from_json(F.col(payload), SERIES)).alias("_s")
    ).withColumn("_p", dotted_parts(F.col("_s.Nombre")))
    tail = F.slice(F.col("_p"), F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0)))
    wanted = series.filter(tail == F.array(*[F.lit(k) for k in keep]))
    return wanted.select(
        *keys,
        F.try_element_at("_p", F.lit(1)).alias("territory"),
        F.col("_s.COD").alias("series_code"),
        F.explode("_s.Data").alias("_d"),
    ).select(
        *keys,
        "territory",
        "series_code",
        F.col("_d.Anyo").alias("yr"),
        F.col("_d.FK_Periodo").alias("period"),
        F.col("_d.Valor").alias("value"),
    )


def _piece(c: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(c, path, kind)


def _entries(container: Column) -> Column:
    """(at, v) of a sparse map ``{"3": v}`` by position; keys that are no position are left out."""
    pairs = F.transform(F.map_entries(_piece(container, "$", "map<string,variant>")), lambda e: F.struct(e["key"].try_cast("int").alias("at"), e["key"].alias("k"), e["value"].alias("v")))
    return F.filter(pairs, lambda e: (e["at"] >= 0) & (e["at"].cast("string") == e["k"]))


def _dense(container: Column, total: Column, kind: str) -> Column:
    """Values of all ``total`` cells in order, from a dense list, a sparse map or nothing.

    A map is sorted once and the gap behind each entry filled, so the work follows the
    number of cells; no cell is looked up in the map.
    """
    gap = lambda n: F.array_repeat(F.lit(None).cast(kind), F.greatest(n, F.lit(0)).cast("int"))
    listed = F.transform(_piece(container, "$", "array<variant>"), lambda v: _piece(v, "$", kind))
    kept = F.filter(F.transform(_entries(container), lambda e: F.struct(e["at"], _piece(e["v"], "$", kind).alias("v"))), lambda e: e["at"] < total)

    def spread_out(e: Column) -> Column:
        first = gap(F.coalesce(F.get(e, F.lit(0))["at"], total))
        runs = F.transform(e, lambda x, i: F.concat(F.array(x["v"]), gap(F.coalesce(F.get(e, i + 1)["at"], total) - x["at"] - 1)))
        return F.concat(first, F.flatten(runs))

    filled = let(F.coalesce(F.array_sort(kept, lambda a, b: a["at"] - b["at"]), F.array().cast(f"array<struct<at:int,v:{kind}>>")), spread_out)
    return F.coalesce(F.concat(F.slice(listed, F.lit(1), total), gap(total - F.size(listed))), filled)


def _number(cell: Column) -> Column:
    """A cell that is a finite number; text, flags and objects are none."""
    kind = F.schema_of_variant(cell)
    return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def _codes(category: Column) -> Column:
    """Codes of a dimension in order, from an ordered list or a map of code to position."""
    placed = F.map_entries(_piece(category, "$.index", "map<string,int>"))
    ordered = F.transform(F.array_sort(F.transform(placed, lambda e: F.struct(e["value"].alias("at"), e["key"].alias("code")))), lambda e: e["code"])
    return F.coalesce(_piece(category, "$.index", "array<string>"), ordered)


def _opened(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    v = F.try_parse_json(payload)
    cube = df.select(*keys, v.alias("_v")).select(
        *keys,
        "_v",
        _piece(F.col("_v"), "$.id", "array<string>").alias("_id"),
        _piece(F.col("_v"), "$.size", "array<int>").alias("_size"),
        _piece(F.col("_v"), "$.value", "variant").alias("_value"),
        _piece(F.col("_v"), "$.status", "variant").alias("_status"),
        _piece(F.col("_v"), "$.dimension", "map<string,variant>").alias("_dimension"),
    )
    return cube.withColumn("_n", F.aggregate("_size", F.lit(1).cast("long"), lambda a, s: a * s).cast("int"))


def _cells(cube: DataFrame, keys: list[str]) -> DataFrame:
    sound = cube.filter((F.size("_id") == F.size("_size")) & (F.col("_n") > 0))
    n = F.col("_n")
    value = F.transform(_dense(F.col("_value"), n, "variant"), lambda c: F.when(_number(c), _piece(c, "$", "double")))
    both = F.arrays_zip(value.alias("value"), _dense(F.col("_status"), n, "string").alias("status"))
    return sound.select("*", F.posexplode(both).alias("pos", "_cell")).withColumns({"value": F.col("_cell.value"), "status": F.col("_cell.status")})


def _coordinate(pos: Column, at: Column) -> Column:
    """Place of a cell along the dimension ``at`` (from 0): row-major, the last dimension runs fastest."""
    stride = F.aggregate(F.slice("_size", at + 2, F.greatest(F.size("_size") - at - 1, F.lit(0))), F.lit(1).cast("long"), lambda a, s: a * s)
    return F.pmod(F.floor(pos / stride), F.get("_size", at)).cast("int")


def cube_rows(df: DataFrame, payload: str, keys: list[str], dims: int) -> DataFrame:
    """(keys, pos, dim0.., value, status): every cell of a cube by the places of its coordinates.

    Values and flags may be dense lists or sparse maps. A cell that is absent stays null,
    a zero stays zero, a cell that is no number is null (``cube_violations`` reports it).
    A payload that cannot be read, or whose sizes do not fit its dimensions, gives no row.
    """
    cells = _cells(_opened(df, payload, keys), keys)
    return cells.select(*keys, "pos", *[_coordinate(F.col("pos"), F.lit(d)).alias(f"dim{d}") for d in range(dims)], "value", "status")


def cube_cells(df: DataFrame, payload: str, keys: list[str], dims: list[str]) -> DataFrame:
    """(keys, pos, each dimension's code and label, value, status), dimensions by name.

    A payload may hold its dimensions in any order and its categories as a list or a map;
    a dimension it lacks has null codes, a code without a label a null label.
    """
    cells = _cells(_opened(df, payload, keys), keys)
    out = []
    for name in dims:
        category = _piece(F.try_element_at("_dimension", F.lit(name)), "$.category", "variant")
        at = F.array_position("_id", name).cast("int") - 1
        code = F.when(at >= 0, F.get(F.col(f"_codes_{name}"), _coordinate(F.col("pos"), at)))
        cells = cells.withColumn(f"_codes_{name}", _codes(category)).withColumn(f"_labels_{name}", _piece(category, "$.label", "map<string,string>")).withColumn(f"_code_{name}", code)
        out += [F.col(f"_code_{name}").alias(name), F.try_element_at(f"_labels_{name}", F.col(f"_code_{name}")).alias(f"{name}_label")]
    return cells.select(*keys, "pos", *out, "value", "status")


def cube_violations(df: DataFrame, payload: str, keys: list[str], dims: list[str] | None = None, single: dict[str, str] | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """(keys, violation): what is wrong with each payload; a sound one gives no row.

    ``dims`` are the dimensions that must be there, no others; ``single`` those that must
    have one given category; numbers must lie from ``low`` to ``high``.
    """
    cube = _opened(df, payload, keys)
    n = F.coalesce(F.col("_n"), F.lit(0))
    at = F.sequence(F.lit(0), F.size("_id") - 1)
    sized = F.coalesce(F.size("_id") == F.size("_size"), F.lit(False))
    category = lambda name: _piece(F.try_element_at("_dimension", name), "$.category", "variant")

    def misplaced(i: Column) -> Column:
        c = category(F.get("_id", i))
        codes = _codes(c)
        places = F.array_sort(F.map_values(_piece(c, "$.index", "map<string,int>")))
        gaps = F.coalesce(places != F.sequence(F.lit(0), F.get("_size", i) - 1), F.lit(False))
        return F.coalesce((F.size(codes) != F.get("_size", i)) | (F.size(F.array_distinct(codes)) != F.size(codes)), F.lit(True)) | gaps

    shape = lambda c: F.coalesce(F.schema_of_variant(c).rlike("^(ARRAY|OBJECT)"), F.lit(False))
    cells = F.coalesce(_piece(F.col("_value"), "$", "array<variant>"), F.map_values(_piece(F.col("_value"), "$", "map<string,variant>")))
    present = F.filter(cells, lambda c: c.isNotNull() & (F.schema_of_variant(c) != "VOID"))
    numbers = F.transform(F.filter(present, _number), lambda c: _piece(c, "$", "double"))
    keys_of = F.map_keys(_piece(F.col("_value"), "$", "map<string,variant>"))
    outside = F.exists(keys_of, lambda k: F.coalesce((k.try_cast("int") < 0) | (k.try_cast("int") >= n) | (k.try_cast("int").cast("string") != k), F.lit(True)))
    beyond = F.size(_piece(F.col("_value"), "$", "array<variant>")) > n
    rules: dict[str, Column] = {
        "unreadable": F.col("_v").isNull() | F.col("_id").isNull() | F.col("_size").isNull(),
        "size_mismatch": ~sized,
        "repeated_dimension": F.size(F.array_distinct("_id")) != F.size("_id"),
        "category_index": sized & F.col("_dimension").isNotNull() & F.exists(at, misplaced),
        "value_container": F.col("_value").isNotNull() & ~shape(F.col("_value")),
        "position_out_of_range": F.coalesce(outside, F.lit(False)) | F.coalesce(beyond, F.lit(False)),
        "not_a_number": F.exists(present, lambda c: ~_number(c)),
        "no_values": F.coalesce(F.size(numbers), F.lit(0)) <= 0,
    }
    if dims is not None:
        rules["unexpected_dimensions"] = F.array_sort("_id") != F.array_sort(F.array(*[F.lit(d) for d in dims]))
    for name, code in (single or {}).items():
        rules[f"unexpected_{name}"] = F.coalesce(_codes(category(F.lit(name))) != F.array(F.lit(code)), F.lit(True))
    if low is not None or high is not None:
        rules["out_of_bounds"] = F.exists(numbers, lambda x: ~F.coalesce(x.between(low if low is not None else float("-inf"), high if high is not None else float("inf")), F.lit(False)))
    found = F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))
    return cube.select(*keys, F.explode(found).alias("violation"))


def wide_years(df: DataFrame, keys: list[str], prefix: str, years: list[int]) -> DataFrame:
    """Columns ``prefixYY`` -> (year, value); only positive finite values survive."""
    names = [f"{prefix}{y % 100:02d}" for y in years]
    long = df.unpivot(keys, names, "_k", "value")
    year = F.lit(2000) + F.right("_k", F.lit(2)).cast("int")
    v = F.col("value")
    return long.select(
        *keys, year.alias("yr"), F.when(finite(v) & (v > 0), v).alias("value")
    )
