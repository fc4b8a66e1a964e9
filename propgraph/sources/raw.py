"""Reader of PSS/E RAW version 33 case files, by Spark functions.

Lines get their section from the last marker above them (``0 / END OF ... DATA, BEGIN ... DATA``),
fields from a CSV parse with single quotes. Only the grouping of a transformer's four or five lines
into a record walks line by line, file by file.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 30
# The fields of each section by position, with their types; empty names are skipped.
BUS = "numero:int nombre:string V_base_kV:double tipo:int area:int zona:int ower:int V_mag_pu:double V_ang_deg:double V_max_pu:double V_min_pu:double V_EVHI_pu:double V_EVLO_pu:double"
LOAD = "bus_numero:int id:string status:int area:int zona:int PL_MW:double QL_MVAR:double IP_MW:double IQ_MVAR:double YP_MW:double YQ_MVAR:double OWNER:string SCALE:int INTRPT:int"
SHUNT = "bus_numero:int id:string status:int GL_MW:double BL_MVAR:double"
GENERATOR = "bus_numero:int id:string P_MW:double Q_MVAR:double Q_max_MVAR:double Q_min_MVAR:double V_set_pu:double IREG:double MVA_base:double ZR:double ZX:double RT:double XT:double GTAP:double status:int RMPCT:double P_max_MW:double P_min_MW:double BASLOD:double"
BRANCH = "from_bus_numero:int to_bus_numero:int _CKT:string R_pu:double X_pu:double B_pu:double rate_A_MVA:double rate_B_MVA:double rate_C_MVA:double GI_pu:double BI_pu:double GJ_pu:double BJ_pu:double status:int metodo:int longitud_km:double owner1:int frac1:double owner2:int frac2:double owner3:int frac3:double owner4:int frac4:double"
ZONE = "zona:int zoname:string"
TRANSFORMER = (
    "from_bus_index:int to_bus_index:int tertiary_bus_index:int ckt_id:string CW:int CZ:int CM:int MAG1:double MAG2:double NMETR:int NAME:string STAT:int - - - - - - - - VECGRP:string",
    "R1_2_pu:double X1_2_pu:double SBASE1_2_MVA:double R2_3_pu:double X2_3_pu:double SBASE2_3_MVA:double R3_1_pu:double X3_1_pu:double SBASE3_1_MVA:double VMSTAR:double ANSTAR:double",
    "WINDV1:double NOMV1:double ANG1:double - - - COD1:int CONT1:int RMA1:double RMI1:double",
    "WINDV2:double NOMV2:double ANG2:double",
    "WINDV3:double NOMV3:double ANG3:double",
)
SECTIONS = {"BUS": ("buses", BUS), "LOAD": ("cargas", LOAD), "FIXED SHUNT": ("shunts", SHUNT), "GENERATOR": ("generadores", GENERATOR), "BRANCH": ("lineas", BRANCH), "ZONE": ("zonas", ZONE)}


def lenient(c: Column, kind: str) -> Column:
    """Blank and unreadable values are 0 or empty; whole numbers may be written as decimals."""
    if kind == "string":
        return F.coalesce(F.trim(c), F.lit(""))
    value = F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))
    return value.cast("int") if kind == "int" else value


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, line, section`` of all data lines; headers have section HEADER, markers none."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("all"))
    each = whole.select("file", F.posexplode("all").alias("n", "line")).filter(~F.trim("line").startswith("@"))
    each = each.withColumn("marker", (F.col("n") >= 3) & F.trim("line").rlike(r"^(0\s*(/|$)|Q\s*$)"))
    begun = F.upper(F.regexp_extract("line", r"(?i)BEGIN\s+(.*?)\s+DATA", 1))
    each = each.withColumn("begun", F.when(F.col("marker"), begun))
    last = F.last("begun", ignorenulls=True).over(Window.partitionBy("file").orderBy("n"))
    section = F.when(F.col("n") < 3, F.lit("HEADER")).otherwise(F.coalesce(last, F.lit("BUS")))
    return each.withColumn("section", section).filter(~F.col("marker") & (F.trim("line") != "")).select("file", "n", "line", "section")


def fields(rows: DataFrame) -> DataFrame:
    """The lines with their fields ``f``: text after a slash outside quotes is a comment."""
    plain = F.regexp_replace("line", r"/[^']*$", "")
    schema = ", ".join(f"c{i} string" for i in range(WIDTH))
    parsed = F.from_csv(plain, schema, {"quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    return rows.withColumn("p", parsed).withColumn("f", F.array(*[F.col(f"p.c{i}") for i in range(WIDTH)])).drop("p")


def layout(text: str) -> list[tuple[int, str, str]]:
    return [(i, *x.split(":")) for i, x in enumerate(text.split()) if x != "-"]


def header(rows: DataFrame) -> DataFrame:
    """``file, base_MVA, version, frecuencia_Hz`` with their defaults."""
    first = fields(rows.filter("section = 'HEADER' AND n = 0"))

    def value(i: int, default: float) -> Column:
        v = F.try_element_at("f", F.lit(i + 1)).try_cast("double")
        return F.coalesce(F.nullif(v, F.lit(0.0)), F.lit(default))

    return first.select("file", value(1, 100.0).alias("base_MVA"), value(2, 33.0).cast("int").alias("version"), value(5, 60.0).alias("frecuencia_Hz"))


def _records(pdf: pd.DataFrame) -> pd.DataFrame:
    """Numbers transformer records and the lines in them: five lines if a third bus is named, else four."""
    pdf = pdf.sort_values("n")
    record, part, out, size = -1, 0, [], 0
    for line in pdf["line"]:
        if part == size:
            record, part = record + 1, 0
            third = line.split(",")[2].strip() if line.count(",") > 1 else "0"
            size = 5 if third not in ("", "0") else 4
        out.append((record, part))
        part += 1
    return pdf.assign(record=[r for r, _ in out], part=[p for _, p in out])[["file", "record", "part", "line"]]


def transformers(rows: DataFrame) -> DataFrame:
    own = rows.filter("section = 'TRANSFORMER'").select("file", "n", "line")
    numbered = fields(own.groupBy("file").applyInPandas(_records, "file string, record int, part int, line string"))
    wide = numbered.groupBy("file", "record").agg(*[F.max(F.when(F.col("part") == i, F.col("f"))).alias(f"f{i}") for i in range(5)])
    picks = []
    for part, text in enumerate(TRANSFORMER):
        picks += [lenient(F.get(F.col(f"f{part}"), F.lit(i)), kind).alias(name) for i, name, kind in layout(text)]
    return wide.select("file", *picks)


def read_raw(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a case file (or of many), loads, generators and shunts also per unit; buses carry their zone's name."""
    rows = lines(spark, path)
    base = header(rows)
    out = {"header": base}
    for section, (name, text) in SECTIONS.items():
        t = fields(rows.filter(F.col("section") == section))
        out[name] = t.select("file", *[lenient(F.get("f", F.lit(i)), kind).alias(n) for i, n, kind in layout(text)])
    out["transformadores"] = transformers(rows)
    out["buses"] = out["buses"].join(out["zonas"], ["file", "zona"], "left")
    for name, pairs in {"cargas": {"PL_pu": "PL_MW", "QL_pu": "QL_MVAR"}, "generadores": {"P_pu": "P_MW", "Q_pu": "Q_MVAR"}, "shunts": {"GL_pu": "GL_MW", "BL_pu": "BL_MVAR"}}.items():
        t = out[name].join(base.select("file", "base_MVA"), "file")
        out[name] = t.withColumns({k: F.col(v) / F.col("base_MVA") for k, v in pairs.items()}).drop("base_MVA")
    return out
