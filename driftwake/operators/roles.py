"""F17. Where a module, a function or a variable stands in a system (layer) and what it does to data (role), by evidence, each with the
reasons that decided. Labels are column expressions over a table of what a reader noticed; nothing is joined or gathered.

Signals are columns: parts (of the module's name), path (its parts), imported (roots), decorators; booleans main_guard, opens, exits, returns,
params, writes_global, reads_global, mutates, container, constant; calls and statements (counts). Later evidence goes before earlier, as
written here.

Edge cases: nulls are no evidence; a name without parts says nothing; the root package's name says nothing, unless it is all there is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwake.values import CALLED_BY_OTHERS, CONFIG_MODULES, LAYER_NAMES, OUTSIDE_MODULES, STORE_MODULES

C = F.col


def yes(name: str) -> Column:
    return F.coalesce(C(name).cast("boolean"), F.lit(False))


def listed(name: str) -> Column:
    return F.coalesce(C(name), F.array().cast("array<string>"))


def first(found: Column) -> Column:
    return F.get(F.filter(found, F.isnotnull), F.lit(0))


def bare(part: Column) -> Column:
    return F.regexp_replace(F.lower(part), r"\.py$", "")


def named_layer(parts: Column) -> Column:
    """struct(layer, part): what a whole part says, the last first, or else how a part begins or ends, the first first."""
    def whole(p: Column) -> Column:
        low = F.regexp_replace(bare(p), "^_+|_+$", "")
        return F.coalesce(*(F.when(low.isin(*names), F.struct(F.lit(layer).alias("layer"), p.alias("part"))) for names, layer in LAYER_NAMES))

    def edge(p: Column) -> Column:
        return F.coalesce(*(F.when(bare(p).rlike(f"^(?:{'|'.join(names)})_|_(?:{'|'.join(names)})$"), F.struct(F.lit(layer).alias("layer"), p.alias("part"))) for names, layer in LAYER_NAMES))

    return F.coalesce(first(F.transform(F.reverse(parts), whole)), first(F.transform(parts, edge)))


def among(name: str, values: tuple[str, ...]) -> Column:
    return F.arrays_overlap(listed(name), F.array(*map(F.lit, values)))


def tails() -> Column:
    return F.transform(listed("decorators"), lambda d: F.lower(F.substring_index(d, ".", -1)))


def handed_out() -> Column:
    return F.arrays_overlap(tails(), F.array(*map(F.lit, CALLED_BY_OTHERS)))


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*(F.when(when, F.lit(said) if isinstance(said, str) else said) for when, said in pairs)))


def module_label() -> Column:
    """struct(layer, evidence) of a module."""
    parts = listed("parts")
    own = F.when(F.size(parts) > 1, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    hint = named_layer(own)
    tested = F.exists(listed("path"), lambda p: bare(p).isin("test", "tests", "conftest") | F.lower(p).startswith("test_"))
    start = F.when(yes("main_guard"), F.lit("entrypoint")).otherwise(hint["layer"])
    store = among("imported", STORE_MODULES) & (start.isNull() | start.isin("domain", "util", "unknown", "orchestration"))
    one = F.when(store, F.lit("data_access")).otherwise(start)
    outside = among("imported", OUTSIDE_MODULES) & (one.isNull() | one.isin("domain", "util", "unknown"))
    two = F.when(outside, F.lit("io_boundary")).otherwise(one)
    config = among("imported", CONFIG_MODULES) & two.isNull()
    three = F.when(handed_out(), F.lit("interface")).otherwise(F.when(config, F.lit("config")).otherwise(two))
    layer = F.coalesce(three, F.when(F.coalesce(C("statements"), F.lit(0)) > 0, "domain").otherwise("unknown"))
    why = reasons(
        (hint.isNotNull(), F.concat(F.lit("its name has "), hint["part"])), (yes("main_guard"), "runs as a program"), (store, "imports a store's or a service's client"), (outside, "imports what touches the system"),
        (config, "imports a reader of settings"), (handed_out(), "declares what others call"), (three.isNull(), "nothing says more"),
    )
    return F.when(tested, F.struct(F.lit("test").alias("layer"), F.array(F.lit("stands among tests")).alias("evidence"))).otherwise(F.struct(layer.alias("layer"), why.alias("evidence")))


def callable_label(module_layer: Column) -> Column:
    """struct(layer, role, evidence) of a function or method in a module of that layer."""
    one = F.when(handed_out(), F.lit("interface")).otherwise(module_layer)
    outside = (yes("opens") | among("imported", OUTSIDE_MODULES)) & one.isin("domain", "util", "unknown", "orchestration")
    layer = F.when(yes("exits"), F.lit("entrypoint")).otherwise(F.when(outside, F.lit("io_boundary")).otherwise(one))
    writes = yes("mutates") | yes("writes_global")
    far = layer.isin("data_access", "io_boundary")
    count = lambda c: F.coalesce(C(c), F.lit(0))
    role = (
        F.when(writes & yes("returns"), "accessor").when(writes, "consumer").when(yes("returns") & yes("params") & ~yes("reads_global"), "transformer").when(yes("returns") & far, "source")
        .when(yes("returns"), "transformer").when(far, "sink").when((count("calls") > 0) & (count("statements") == 0), "control").otherwise("consumer")
    )
    why = reasons((handed_out(), "decorated as what others call"), (outside, "touches the system itself"), (yes("exits"), "ends the process"), (writes, "writes state of others"), (~writes & yes("returns"), "gives a value back"), (~writes & ~yes("returns") & far, "sends data out"))
    return F.struct(layer.alias("layer"), role.alias("role"), why.alias("evidence"))


def variable_label(module_layer: Column) -> Column:
    """struct(layer, role): of a variable of a module."""
    layer = F.when(yes("constant"), F.when(module_layer == "test", "test").otherwise("config")).when(yes("container"), "state").otherwise(module_layer)
    return F.struct(layer.alias("layer"), F.lit("store").alias("role"))
