"""Domain tables derived from the TPC-H-like tables, once as Spark frames and once as SQL text.

Both come from the same column expressions; `{...}` marks the few spellings
that differ between the two SQL dialects.  All derivations are per row, so
every view grows with its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strikehaz.fixed_values import COMPASS, TAXONOMY

SPARK = {
    "text": "STRING", "clock": "date_format({0}, 'HH:mm')", "micros": "unix_micros(CAST({0} AS TIMESTAMP))",
    "plus_minutes": "{0} + make_dt_interval(0, 0, CAST({1} AS INT), 0)", "ntz": "TIMESTAMP_NTZ '{0}'",
    "nth": "element_at({0}, CAST({1} AS INT) + 1)", "list": "array({0})", "quote": "`{0}`", "day": "CAST({0} AS DATE)",
}
DUCK = {
    "text": "VARCHAR", "clock": "strftime({0}, '%H:%M')", "micros": "epoch_us({0})",
    "plus_minutes": "{0} + to_minutes(CAST({1} AS BIGINT))", "ntz": "TIMESTAMP '{0}'",
    "nth": "({0})[CAST({1} AS INT) + 1]", "list": "[{0}]", "quote": '"{0}"', "day": "CAST({0} AS DATE)",
}


class _Dialect:
    def __init__(self, spellings: dict[str, str]):
        self.s = spellings

    def __call__(self, name: str, *args: str) -> str:
        return self.s[name].format(*args)

    def text(self, expr: str) -> str:
        return f"CAST({expr} AS {self.s['text']})"

    def pick(self, values: list[str | None], index: str) -> str:
        items = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
        return self("nth", self("list", items), index)


def _lat(k: str, m: int) -> str:
    return (
        f"CASE WHEN {k} % 5 = 4 THEN 34 + (({k} * {m}) % 380) / 10e0 WHEN {k} % 5 = 3 THEN -50 + (({k} * {m}) % 1000) / 10e0 "
        f"ELSE 24 + (({k} * {m}) % 260) / 10e0 END"
    )


def _lon(k: str, m: int) -> str:
    far = f"(({k} * {m}) % 1600)"
    return (
        f"CASE WHEN {k} % 5 = 4 THEN -25 + (({k} * {m}) % 700) / 10e0 "
        f"WHEN {k} % 5 = 3 AND {far} >= 800 THEN -260 + {far} / 10e0 WHEN {k} % 5 = 3 THEN 100 + {far} / 10e0 "
        f"ELSE -125 + (({k} * {m}) % 590) / 10e0 END"
    )


SCIENTIFIC = [t[0] for t in TAXONOMY]
COMMON = [t[1] for t in TAXONOMY]
QUERY_START = "2024-01-01 00:00:00"


def _columns(d: _Dialect) -> dict[str, tuple[str, dict[str, str]]]:
    """view -> (table, {column: expression})."""
    k = "o_orderkey"
    clock = d("clock", "ts")
    return {
        "sites": ("supplier", {
            "site_id": "s_suppkey", "site_name": "s_name",
            "latitude": _lat("s_suppkey", 37), "longitude": _lon("s_suppkey", 61),
            "timezone": "CASE WHEN s_suppkey % 5 = 4 THEN 'Etc/GMT-1' WHEN s_suppkey % 10 = 3 THEN 'Not/AZone' "
                        "WHEN s_suppkey % 10 = 8 THEN NULL ELSE 'Etc/GMT+5' END",
        }),
        "airports": ("customer", {
            "airport_id": "c_custkey", "airport_name": "c_name", "state": d.text("c_nationkey"),
            "latitude": _lat("c_custkey", 53), "longitude": _lon("c_custkey", 97),
        }),
        "counts": ("events", {
            "count_id": "event_id", "site_id": "user_id", "count_date": d("day", "ts"),
            "start_time_local": f"CASE WHEN event_id % 89 = 0 THEN NULL ELSE {clock} END",
            "end_time_local": f"CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '06:30' ELSE {d('clock', d('plus_minutes', 'ts', '60'))} END",
            "observation_hours": "CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 61 = 0 THEN -1e0 ELSE (1 + user_id % 3) * 1e0 END",
            "species_scientific_name": d.pick([*SCIENTIFIC, None, "Unknown species"], "event_id % 23"),
            "species_common_name": d.pick([*COMMON, "Hoopoe", None], "event_id % 23"),
            "count": "CASE WHEN event_id % 97 = 0 THEN -1 ELSE CAST(floor(value) AS BIGINT) END",
            "flight_direction": d.pick([*COMPASS, None, "X"], "event_id % 10"),
            "count_type": "CASE event_type WHEN 'view' THEN 'visible_migration' WHEN 'click' THEN 'capture' "
                          "WHEN 'purchase' THEN 'nocturnal_flight_call' WHEN 'signup' THEN 'other' ELSE 'ringing_demo' END",
            "observer_effort_available": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 4 <> 0 END",
        }),
        "weather": ("events", {
            "obs_id": "event_id", "station_id": "user_id", "timestamp_utc": "ts",
            "latitude": _lat("user_id", 37), "longitude": _lon("user_id", 61), "temperature_c": "value",
        }),
        "queries": ("orders", {
            "query_id": k, "longitude": _lon("o_custkey", 97), "latitude": _lat("o_custkey", 53),
            "query_timestamp_utc": d("plus_minutes", d("ntz", QUERY_START), f"({k} * 7919) % 44640"),
        }),
        "strikes": ("orders", {
            "record_id": k, "incident_date": "o_orderdate", "airport_id": "o_custkey",
            "damage_flag": "CASE o_orderstatus WHEN 'F' THEN " + d.pick([" y ", "Yes", "true", "1"], f"{k} % 4")
                           + " WHEN 'O' THEN " + d.pick(["n", "No", "FALSE", "None"], f"{k} % 4")
                           + " ELSE " + d.pick(["", "UNK", "N/A", None], f"{k} % 4") + " END",
            "species": d.pick([*COMMON], f"{k} % 21"), "injuries": f"CASE WHEN {k} % 50 = 0 THEN 1 ELSE 0 END",
            "phase": "o_orderpriority", "totalprice": "o_totalprice",
        }),
        "raw": ("orders", {
            "INDEX_NR": d.text(k),
            "INCIDENT_DATE": f"CASE WHEN {k} % 41 = 0 THEN 'not a date' ELSE {d.text(d('day', 'o_orderdate'))} END",
            "INCIDENT_YEAR": f"CASE WHEN {k} % 37 = 0 THEN NULL ELSE {d.text('year(o_orderdate) + 23')} END",
            "INCIDENT_MONTH": f"CASE WHEN {k} % 29 = 0 THEN NULL ELSE {d.text('month(o_orderdate)')} END",
            "OPERATOR": d.pick([" business", "Privately Owned ", "commercial", None], "o_custkey % 4"),
            "AC_CLASS": f"CASE WHEN {k} % 5 <> 0 THEN ' a ' ELSE 'B' END",
            "AC_MASS": d.text(f"1 + {k} % 4"), "TYPE_ENG": d.pick(["a", "D", None], f"{k} % 3"),
            "NUM_ENGS": f"CASE WHEN {k} % 31 = 0 THEN 'two' ELSE {d.text(f'1 + {k} % 2')} END",
            "ENG_1_POS": d.text(f"{k} % 7"), "ENG_2_POS": f"CASE WHEN {k} % 2 = 0 THEN NULL ELSE {d.text(f'{k} % 5')} END",
            "AIRCRAFT": f"concat('T-', {d.text(f'{k} % 40')})", "AIRPORT_ID": d.text("o_custkey"),
            "STATE": f"concat('S', {d.text('o_custkey % 25')})",
            "FAAREGION": d.pick(["AAL", "ACE", "AEA", "AGL", "ANE", "ANM", "ASO", "FGN", "AWP"], "o_custkey % 9"),
            "SKY": d.pick(["No Cloud", "Some Cloud", "Overcast"], f"{k} % 3"),
            "PRECIPITATION": f"CASE WHEN {k} % 4 = 0 THEN 'Rain' ELSE NULL END", "PHASE_OF_FLIGHT": "o_orderpriority",
            "HEIGHT": f"CASE WHEN {k} % 23 = 0 THEN 'N/A' ELSE {d.text(f'({k} * 131) % 9000')} END",
            "SPEED": f"CASE WHEN {k} % 19 = 0 THEN NULL ELSE {d.text(f'60 + ({k} * 17) % 200')} END",
            "TIME_OF_DAY": d.pick(["Day", "Night", "Dawn", "Dusk", None], f"{k} % 5"),
            "WARNED": d.pick(["No", "Yes", "Unknown"], f"{k} % 3"),
            "INDICATED_DAMAGE": "CASE o_orderstatus WHEN 'F' THEN " + d.pick(["1", " y"], f"{k} % 2")
                                + " WHEN 'O' THEN " + d.pick(["0", "n "], f"{k} % 2") + " ELSE " + d.pick([None, "unk"], f"{k} % 2") + " END",
            "DAMAGE_LEVEL": "CASE o_orderstatus WHEN 'F' THEN " + d.pick(["M", "m?", "S", "d", "N", None], f"{k} % 6")
                            + " ELSE " + d.pick(["N", None, "", "n", "S", None], f"{k} % 6") + " END",
            "SPECIES": "CASE WHEN " + f"{k} % 2 = 0 THEN upper(" + d.pick(COMMON, f"{k} % 21") + ") ELSE " + d.pick(COMMON, f"{k} % 21") + " END",
            "LATITUDE": f"CASE WHEN {k} % 43 = 0 THEN NULL ELSE {d.text(_lat('o_custkey', 53))} END",
            "LONGITUDE": f"CASE WHEN {k} % 47 = 0 THEN '999' ELSE {d.text(_lon('o_custkey', 97))} END",
            "NR_INJURIES": f"CASE WHEN {k} % 50 = 0 THEN '1' ELSE NULL END",
        }),
        "export": ("orders", {
            "INDEX NR": d.text(k), "incident date": f"CASE WHEN {k} % 41 = 0 THEN 'not a date' ELSE {d.text(d('day', 'o_orderdate'))} END",
            "TIME": f"CASE WHEN {k} % 13 = 0 THEN '25:99' WHEN {k} % 11 = 0 THEN NULL ELSE '08:15' END",
            "AIRPORT CODE": d.text("o_custkey"), "LAT": f"CASE WHEN {k} % 43 = 0 THEN 'unknown' ELSE {d.text(_lat('o_custkey', 53))} END",
            "LONG": d.text(_lon("o_custkey", 97)), "HEIGHT (FT)": f"CASE WHEN {k} % 23 = 0 THEN '12d' ELSE {d.text(f'({k} * 131) % 9000')} END",
            "DAMAGE_FLAG": "o_orderstatus", "SPECIES_NAME": "o_orderpriority", "UNKNOWN HEADER": "o_orderpriority",
        }),
        "scores": ("orders", {
            "id": k, "y": "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE NULL END",
            "p": f"(({k} * 7919) % 1009 + CASE o_orderstatus WHEN 'F' THEN 200 ELSE 0 END) / 1209e0",
            "split_no": f"{k} % 10",
        }),
        "stacked": ("labels", {
            "id": "doc_id", "y": "quality", "p_a": "((doc_id * 7919) % 1009) / 1009e0",
            "p_b": "(((doc_id * 104729) % 997) + 300 * quality) / 1297e0", "p_c": "CASE WHEN (doc_id * 31) % 7 < 3 THEN 1e0 ELSE 0e0 END",
        }),
        "moves": ("lineitem", {
            "part_id": "l_partkey", "year": "CAST(year(l_shipdate) + 21 AS INT)", "month": "CAST(month(l_shipdate) AS INT)",
            "birds": "CAST(floor(l_quantity) AS BIGINT)", "returnflag": "l_returnflag", "linestatus": "l_linestatus",
            "order_id": "l_orderkey", "supplier_id": "l_suppkey",
        }),
        "species_of_part": ("part", {"part_id": "p_partkey", "species": "concat(p_type, ' ', p_brand)"}),
    }


_SPARK_VIEWS = _columns(_Dialect(SPARK))
_DUCK_VIEWS = _columns(_Dialect(DUCK))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain view as a Spark frame."""
    source, columns = _SPARK_VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def column_names(name: str) -> list[str]:
    """Columns of a view in order."""
    return list(_SPARK_VIEWS[name][1])


def sql(name: str) -> str:
    """The same view as a parenthesised SQL sub-select."""
    source, columns = _DUCK_VIEWS[name]
    return "(SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {source})"


def with_views(*names: str) -> str:
    """'WITH v_a AS (...), v_b AS (...)' for an oracle query."""
    return "WITH " + ", ".join(f"v_{n} AS {sql(n)}" for n in names)
