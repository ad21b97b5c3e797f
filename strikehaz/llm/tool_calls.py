"""Chat formatting: tool calls linked to results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikehaz.llm.common import stored

BLOCK = 1000  # turns numbered together; a conversation of any length spreads over its blocks


def canonical(json: Column) -> Column:
    """JSON without blanks, its keys sorted at every level; null where it can't be parsed."""
    return F.to_json(F.try_parse_json(json))


def _argument_faults(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, faults): what is wrong with the arguments of each call that has faults."""
    spark = calls.sparkSession
    parsed = calls.select("conv_id", "call_id", "name", F.try_parse_json("arguments").alias("given"))
    kind = F.coalesce(F.schema_of_variant("given"), F.lit(""))
    broken = parsed.where(~kind.startswith("OBJECT")).select("conv_id", "call_id", F.lit("arguments are no object").alias("fault"))
    objects = parsed.where(kind.startswith("OBJECT"))
    had = objects.lateralJoin(spark.tvf.variant_explode(F.col("given").outer())).select(
        "conv_id", "call_id", "name", F.col("key").alias("parameter"), F.schema_of_variant("value").alias("type"))
    kinds = (
        F.when(F.col("type") == "BIGINT", "integer").when(F.col("type").rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(F.col("type") == "STRING", "string")
        .when(F.col("type") == "BOOLEAN", "boolean").when(F.col("type").startswith("ARRAY"), "array").when(F.col("type").startswith("OBJECT"), "object").otherwise("null")
    )
    checked = had.withColumn("found", kinds).join(schemas.select("name", "parameter", F.col("kind").alias("wanted")), ["name", "parameter"], "left")
    fits = (F.col("found") == F.col("wanted")) | ((F.col("wanted") == "number") & (F.col("found") == "integer"))
    wrong = checked.where(F.col("wanted").isNull() | ~fits).select(
        "conv_id", "call_id",
        F.when(F.col("wanted").isNull(), F.concat(F.lit("unknown parameter "), "parameter"))
        .otherwise(F.concat("parameter", F.lit(" is no "), "wanted")).alias("fault"))
    needed = objects.select("conv_id", "call_id", "name").join(schemas.where("required").select("name", "parameter"), "name")
    missing = needed.join(had.select("conv_id", "call_id", "parameter"), ["conv_id", "call_id", "parameter"], "left_anti").select(
        "conv_id", "call_id", F.concat(F.lit("missing "), "parameter").alias("fault"))
    known = schemas.select("name").distinct()
    strange = calls.join(known, "name", "left_anti").select("conv_id", "call_id", F.lit("unknown tool").alias("fault"))
    faults = broken.unionByName(wrong.join(known.join(calls.select("conv_id", "call_id", "name"), "name"), ["conv_id", "call_id"], "left_semi")).unionByName(missing).unionByName(strange)
    return faults.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("fault")).alias("faults"))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): depth of calls in conversations where a dependency stands later.

    Elsewhere the given order is topological already.  Round by round, the calls whose
    dependencies are all placed get the next level; what is left in the end lies on or behind a
    cycle and has no level.  Dependencies on unknown calls count as placed.
    """
    edges = calls.select("conv_id", "call_id", "turn", F.explode("after").alias("needs"))
    targets = calls.select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("at"))
    linked = edges.join(targets, ["conv_id", "needs"])
    later = F.struct("at", "needs") >= F.struct("turn", "call_id")
    affected = stored(linked.where(later).select("conv_id").distinct())
    schema = calls.select("conv_id", "call_id").schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ")
    placed = calls.sparkSession.createDataFrame([], schema + ", level int")
    if affected.isEmpty():
        return placed
    open_ = stored(calls.select("conv_id", "call_id").join(affected, "conv_id", "left_semi"))
    needs = stored(linked.select("conv_id", "call_id", "needs").join(affected, "conv_id", "left_semi").distinct())
    level = 0
    while True:
        waiting = needs.join(open_.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi").select("conv_id", "call_id").distinct()
        ready = stored(open_.join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return placed.unionByName(open_.withColumn("level", F.lit(None).cast("int")))
        placed = placed.unionByName(ready)
        open_ = stored(open_.join(ready, ["conv_id", "call_id"], "left_anti"))
        level += 1


def linked_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, step, call_id, turn, result_turn, status, faults, json): one row for each distinct call.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (ids it depends on);
    results: conv_id, call_id, turn, content; schemas: name, parameter, kind, required.
    Calls and results are joined by (conv_id, call_id).  Of repeated ids the call and the result with the
    smallest turn count (then the smallest text).  Steps number the calls of a conversation in topological order:
    by level where a dependency stands later than the call, else as given (turn, then id).
    status is, in this order: "cyclic" (no order exists, steps follow the rest), "invalid" (faults of
    the arguments against the schema), "unanswered", "ok".  json has the call, its arguments and its
    result with sorted keys and no blanks; arguments that are no JSON are a string.  Null
    arguments are invalid, null ids link nothing and are left out, as are null conversations; results without a call are in
    `orphans`.  Other columns are not read, empty tables give an empty result.
    """
    own = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))).alias("c")).select("conv_id", "call_id", "c.*")
    answers = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("r")).select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"))
    own = stored(own)
    key = ["conv_id", "call_id"]
    levels = _levels(own).withColumn("leveled", F.lit(True))
    full = own.join(answers, key, "left").join(_argument_faults(own, schemas), key, "left").join(levels, key, "left")
    cyclic = F.col("leveled") & F.col("level").isNull()
    faults = F.coalesce("faults", F.array().cast("array<string>"))
    status = F.when(cyclic, "cyclic").when(F.size(faults) > 0, "invalid").when(F.col("result_turn").isNull(), "unanswered").otherwise("ok")
    quoted = F.coalesce(canonical(F.col("arguments")), F.to_json(F.to_variant_object(F.array("arguments"))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array("arguments")))) - 2), F.lit("null"))
    shown = full.withColumn("status", F.coalesce(status, F.lit("ok"))).withColumn("faults", faults).withColumn("level", F.when(F.coalesce(cyclic, F.lit(False)), F.lit(2**30)).otherwise(F.coalesce("level", F.lit(0))))
    rest = F.to_json(F.struct(F.col("call_id"), F.col("conv_id"), F.col("name"), F.col("content").alias("result")), {"ignoreNullFields": "false"})
    shown = shown.withColumn("json", F.concat(F.lit('{"arguments":'), quoted, F.lit(","), rest.substr(F.lit(2), F.length(rest))))
    block = F.floor(F.col("turn") / BLOCK)
    within = Window.partitionBy("conv_id", "level", "block").orderBy("turn", "call_id")
    numbered = shown.withColumn("block", block).withColumn("within", F.row_number().over(within))
    sizes = numbered.groupBy("conv_id", "level", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("level", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("conv_id").alias("__conv"), F.col("level").alias("__level"), F.col("block").alias("__block"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    same = (F.col("conv_id") == F.col("__conv")) & (F.col("level") == F.col("__level")) & F.col("block").eqNullSafe(F.col("__block"))
    return numbered.join(starts, same).select(
        "conv_id", (F.col("before") + F.col("within")).alias("step"), "call_id", "turn", "result_turn", "status", F.array_join("faults", "; ").alias("faults"), "json")


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose (conv_id, call_id) no call has, null ids included."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
