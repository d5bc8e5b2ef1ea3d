"""Quantities recorded in different units, brought to one unit per test.

Pure column expressions: the unit text is folded to a key, the key is joined to
the spellings of the test's own units, the unit field wins over the unit told in
the label text, and the value is multiplied by the unit's factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwise.session import broadcast_if_small

# Spellings of each unit after folding (lower case, no blanks, micro sign as u, "per" as "/", "litre" as l).
SPELLINGS = {
    "mg/dl": ["mg/dl", "mg%", "mg/100ml", "mgs/dl", "mgm/dl", "mgm%", "milligrams/dl", "mg/decil", "mg.dl-1"],
    "g/dl": ["g/dl", "g%", "gm/dl", "gm%", "gms/dl", "gms%", "g/100ml", "gm/100ml", "grams/dl", "gram/dl"],
    "g/l": ["g/l", "gm/l", "gms/l", "grams/l", "gram/l"],
    "mg/l": ["mg/l", "mgs/l", "mgm/l"],
    "ug/dl": ["ug/dl", "mcg/dl", "microg/dl", "ug%", "ug/100ml", "mcg%", "mcg/100ml"],
    "ug/l": ["ug/l", "mcg/l", "microg/l"],
    "ng/ml": ["ng/ml", "nanog/ml"],
    "ng/dl": ["ng/dl", "ng%", "ng/100ml", "nanog/dl"],
    "ng/l": ["ng/l", "nanog/l"],
    "pg/ml": ["pg/ml"],
    "mmol/l": ["mmol/l", "mm", "millimol/l", "mmoles/l", "mmols/l"],
    "umol/l": ["umol/l", "um", "micromol/l", "mcmol/l", "umoles/l", "umols/l"],
    "nmol/l": ["nmol/l", "nm", "nanomol/l", "nmoles/l"],
    "pmol/l": ["pmol/l", "pm", "picomol/l", "pmoles/l"],
    "meq/l": ["meq/l", "meqs/l"],
    "%": ["%", "percent", "pct", "percentage", "prct"],
    "l/l": ["l/l", "fractionof1", "fraction", "ratioof1"],
    "k/ul": ["k/ul", "thou/mm3", "10*3/ul", "x10e3/ul", "10e3/ul", "10^3/ul", "x10^3/ul", "x10*3/ul", "k/mm3", "k/cmm", "thou/ul", "thou/cmm", "10*9/l", "10^9/l", "x10^9/l", "x10e9/l", "10e9/l", "g/ul", "thousand/ul"],
    "cells/ul": ["cells/ul", "cells/mm3", "/ul", "/cmm", "/mm3", "cells/cmm", "#/ul", "cell/ul"],
    "iu/l": ["iu/l", "u/l", "units/l", "intunits/l"],
    "u/l": ["u/l", "iu/l", "units/l", "intunits/l"],
    "iu/ml": ["iu/ml", "u/ml", "units/ml"],
    "sec": ["sec", "s", "secs", "second", "seconds"],
}


def unit_key(text: Column) -> Column:
    """Fold a unit's spelling: case, blanks, micro signs, 'per', 'litre'."""
    x = F.translate(F.lower(text), "µμ³", "uu3")
    x = F.regexp_replace(x, r"\blit(?:re|er)s?\b", "l")
    x = F.regexp_replace(x, r"\bper\b", "/")
    return F.regexp_replace(x, r"[\s ]+", "")


def unit_in_label(label: Column, test: Column) -> Column:
    """The part of a free-hand label that is neither the test's name nor decoration."""
    rest = F.replace(F.lower(label), F.lower(test), F.lit(" "))
    rest = F.regexp_replace(rest, r"^[\s,;:()\[\]{}–-]+|[\s,;:()\[\]{}–-]+$", "")
    return F.regexp_replace(rest, r"^(?:(?:result|results|in|as|unit|units|reported)\b[\s:]*)+", "")


def parse_quantity(text: Column) -> Column:
    """struct(number, unit) told by a text such as '5,2 mmol/L'; nulls where it holds no number."""
    number = F.regexp_extract(text, r"(-?\d+(?:[.,]\d+)?)\s*([^\d\s].*)?$", 1)
    return F.struct(
        F.when(number != "", F.replace(number, F.lit(","), F.lit(".")).cast("double")).alias("number"),
        F.nullif(F.trim(F.regexp_extract(text, r"(-?\d+(?:[.,]\d+)?)\s*([^\d\s].*)?$", 2)), F.lit("")).alias("unit"),
    )


def unit_dictionary(items: DataFrame, units: DataFrame) -> DataFrame:
    """(itemid, unit_key) -> unit_code, factor, is_common, for every spelling of every unit of the item's test.

    One row per key: where two units of a test share a spelling, the unit whose own
    code is that spelling wins, then the common one, then the code in order.
    """
    spark = items.sparkSession
    spell = spark.createDataFrame([(k, s) for k, all_ in SPELLINGS.items() for s in all_], "own string, unit_key string")
    tests = items.select("itemid", F.trim("label").alias("test")).filter(F.length("test") > 0).dropDuplicates(["itemid"])
    own = units.select(
        F.lower(F.trim("label")).alias("t"), "unit_code", F.col("factor_to_common").alias("factor"), (F.col("offset_to_common") if "offset_to_common" in units.columns else F.lit(0.0)).cast("double").alias("offset"), F.coalesce("is_common", F.lit(False)).alias("is_common"), unit_key(F.col("unit_code")).alias("own")
    ).filter(F.col("unit_code").isNotNull())
    known = own.join(spell, "own", "left").withColumn("unit_key", F.explode(F.array_distinct(F.array(F.col("own"), F.coalesce("unit_key", F.col("own"))))))
    best = F.min_by(F.struct("unit_code", "factor", "offset", "is_common"), F.struct((F.col("own") != F.col("unit_key")).cast("int"), (~F.col("is_common")).cast("int"), "unit_code"))
    per_test = known.groupBy("t", "unit_key").agg(best.alias("b")).select("t", "unit_key", "b.*")
    common = own.filter("is_common").groupBy("t").agg(F.min("unit_code").alias("common_code"))
    return tests.join(per_test, F.lower("test") == F.col("t")).join(common, "t", "left").select("itemid", "test", "unit_key", "unit_code", "factor", "offset", "is_common", "common_code")


#: Distinct (itemid, label, valueuom) triples up to which spellings are resolved once per triple.
TRIPLES = 500_000


def to_common_units(readings: DataFrame, items: DataFrame, units: DataFrame) -> DataFrame:
    """Each reading with unit_code, unit_from (field, text, default, none), common_code, value_common and in_common_unit.

    Needs itemid, label, valuenum, valueuom in `readings`; other columns pass through,
    columns named like a result's are replaced. A unit field that names no unit of the
    item's test yields to the label's text; a row that names none is taken to be in the
    common unit (`default`); an item without a test keeps its value (`none`). Null and
    NaN values give null. Rows are never lost or repeated. `units` may have a column
    offset_to_common, added after the factor (temperatures); without it offsets are 0.

    Spellings repeat, so they are resolved once per distinct triple of item, label and
    unit field (a map-side combined distinct) and joined back by broadcast; where the
    triples are too many for that, each row is resolved in place. No reading is shuffled.
    """
    base = readings.drop("unit_code", "unit_from", "value_common", "common_code", "in_common_unit")
    keys = ["itemid", "label", "valueuom"]
    triples = base.select(*keys).distinct()
    resolved = _resolve(triples, items, units)
    head = resolved.limit(TRIPLES + 1).toArrow()
    if head.num_rows <= TRIPLES:
        known = F.broadcast(base.sparkSession.createDataFrame(head, resolved.schema))
        known = known.select(*[F.col(k).alias(f"_{k}") for k in keys], "_to")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        joined = base.join(known, same, "left").drop(*[f"_{k}" for k in keys])
    else:
        joined = _resolve(base, items, units)
    value = F.when(~F.isnan("valuenum"), F.col("valuenum"))
    return joined.select(
        *[F.col(f"`{c}`") for c in base.columns],
        *[F.col(f"_to.{c}").alias(c) for c in ("unit_code", "unit_from", "common_code")],
        (value * F.col("_to.factor") + F.col("_to.offset")).alias("value_common"),
        F.col("_to.is_common").alias("in_common_unit"),
    )


def _resolve(rows: DataFrame, items: DataFrame, units: DataFrame) -> DataFrame:
    """`rows` with a struct `_to`: the unit each is recorded in and the way to the common one."""
    lookup = broadcast_if_small(unit_dictionary(items, units))
    tests = broadcast_if_small(
        items.select("itemid", F.trim("label").alias("_test"))
        .filter(F.length("_test") > 0)
        .dropDuplicates(["itemid"])
        .join(units.filter("is_common").groupBy(F.lower(F.trim("label")).alias("_l")).agg(F.min("unit_code").alias("_common")), F.lower("_test") == F.col("_l"), "left")
        .drop("_l")
    )
    named = F.struct("unit_code", "factor", "offset", "is_common", "common_code")
    field = lookup.select(F.col("itemid").alias("_fi"), F.col("unit_key").alias("_fk"), named.alias("_field"))
    text = lookup.select(F.col("itemid").alias("_ti"), F.col("unit_key").alias("_tk"), named.alias("_text"))
    joined = (
        rows.join(tests, "itemid", "left")
        .withColumn("_uk", unit_key(F.col("valueuom")))
        .withColumn("_lk", unit_key(unit_in_label(F.col("label"), F.col("_test"))))
        .join(field, (F.col("itemid") == F.col("_fi")) & (F.col("_uk") == F.col("_fk")), "left")
        .join(text, (F.col("itemid") == F.col("_ti")) & (F.col("_lk") == F.col("_tk")), "left")
        .withColumn("_unit", F.coalesce("_field", "_text"))
    )
    told = F.when(F.col("_field").isNotNull(), "field").when(F.col("_text").isNotNull(), "text").when(F.col("_common").isNotNull(), "default").otherwise("none")
    to = F.struct(
        F.coalesce("_unit.unit_code", "_common").alias("unit_code"),
        told.alias("unit_from"),
        F.coalesce("_common", "_unit.common_code").alias("common_code"),
        F.coalesce("_unit.factor", F.lit(1.0)).alias("factor"),
        F.coalesce("_unit.offset", F.lit(0.0)).alias("offset"),
        F.coalesce("_unit.is_common", F.lit(True)).alias("is_common"),
    )
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], to.alias("_to"))
