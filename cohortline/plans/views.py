"""The given tables read as visits, outcomes, scores, model frames and runs.

Each view exists twice: as a DataFrame and as a SQL expression for an independent check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def key() -> Column:
    return F.col("o_orderkey")


class Tables:
    """Parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _flag(c: Column) -> Column:
    return c.cast("int")


VISITS = """visits AS (
  SELECT o_orderkey AS visit_id, o_custkey AS person_id, o_custkey % 83 + 10 AS age,
    CASE WHEN o_orderstatus = 'F' THEN 'Traditional' ELSE 'Laser' END AS technique,
    o_totalprice AS cost, o_orderpriority AS cost_type,
    (45 + o_orderkey % 80)::DOUBLE AS weight_kg,
    CASE WHEN o_orderkey % 89 <> 0 THEN 1.5e0 + (o_orderkey % 45) / 100e0 END AS height_m,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN 'bad'
      ELSE concat(100 + o_orderkey % 60, '/', 60 + o_orderkey % 40) END AS bp,
    CASE o_orderkey % 7 WHEN 0 THEN 'DM2' WHEN 1 THEN 'htn, dm' WHEN 2 THEN NULL WHEN 3 THEN 'HTN' ELSE '0' END
      AS comorbid,
    (o_orderkey % 5 = 0)::INT AS pain, (o_orderkey % 11 = 0)::INT AS bleeding,
    (o_orderkey % 13 = 0)::INT AS edema, (o_orderkey % 17 = 0)::INT AS infection
  FROM orders)"""


def visits(t: Tables) -> DataFrame:
    k = key()
    return t.orders.select(
        k.alias("visit_id"), F.col("o_custkey").alias("person_id"), (F.col("o_custkey") % 83 + 10).alias("age"),
        F.when(F.col("o_orderstatus") == "F", "Traditional").otherwise("Laser").alias("technique"),
        F.col("o_totalprice").alias("cost"), F.col("o_orderpriority").alias("cost_type"),
        (45 + k % 80).cast("double").alias("weight_kg"),
        F.when(k % 89 != 0, F.lit(1.5) + (k % 45) / F.lit(100.0)).alias("height_m"),
        F.when(k % 97 == 0, None).when(k % 101 == 0, "bad")
        .otherwise(F.concat((100 + k % 60).cast("string"), F.lit("/"), (60 + k % 40).cast("string"))).alias("bp"),
        F.when(k % 7 == 0, "DM2").when(k % 7 == 1, "htn, dm").when(k % 7 == 2, None).when(k % 7 == 3, "HTN")
        .otherwise("0").alias("comorbid"),
        _flag(k % 5 == 0).alias("pain"), _flag(k % 11 == 0).alias("bleeding"),
        _flag(k % 13 == 0).alias("edema"), _flag(k % 17 == 0).alias("infection"))


# visits with the person's segment as origin
PLACED = VISITS + """, placed AS (
  SELECT visits.*, c_mktsegment AS origin FROM visits JOIN customer ON person_id = c_custkey)"""


def placed(t: Tables) -> DataFrame:
    people = t.customer.select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("origin"))
    return visits(t).join(people, "person_id")


RAW_STRINGS = """raw_strings AS (
  SELECT o_orderkey AS id,
    CASE o_orderkey % 11 WHEN 0 THEN '--' WHEN 1 THEN '..' WHEN 2 THEN '' WHEN 3 THEN 'a--b' WHEN 4 THEN NULL
      ELSE format('{:,.2f}', o_totalprice) END AS amount,
    CASE WHEN o_orderkey % 9 = 0 THEN '--' ELSE (o_orderkey % 100)::VARCHAR END AS numeric_text,
    (o_orderkey % 50)::VARCHAR AS integer_text,
    CASE WHEN o_orderkey = 7 THEN 'seven' ELSE (o_orderkey % 10)::VARCHAR END AS one_bad,
    CASE WHEN o_orderkey % 23 = 0 THEN '12d' ELSE concat(o_orderkey % 9, '.5') END AS typed_text
  FROM orders)"""


def raw_strings(t: Tables) -> DataFrame:
    k = key()
    return t.orders.select(
        k.alias("id"),
        F.when(k % 11 == 0, "--").when(k % 11 == 1, "..").when(k % 11 == 2, "").when(k % 11 == 3, "a--b")
        .when(k % 11 == 4, None).otherwise(F.format_number("o_totalprice", 2)).alias("amount"),
        F.when(k % 9 == 0, "--").otherwise((k % 100).cast("string")).alias("numeric_text"),
        (k % 50).cast("string").alias("integer_text"),
        F.when(k == 7, "seven").otherwise((k % 10).cast("string")).alias("one_bad"),
        F.when(k % 23 == 0, "12d").otherwise(F.concat((k % 9).cast("string"), F.lit(".5"))).alias("typed_text"))


SCORED = """scored AS (
  SELECT o_orderkey AS id, (o_orderstatus = 'F')::INT AS y,
    ((o_orderkey * 7919) % 701 + 299 * (o_orderstatus = 'F')::INT) / 1000e0 AS signal,
    ((o_orderkey * 104729) % 1001) / 1000e0 AS noise, (o_orderkey % 10)::INT AS fold,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Laser' ELSE 'Traditional' END AS arm
  FROM orders)"""


def scored(t: Tables) -> DataFrame:
    k, y = key(), _flag(F.col("o_orderstatus") == "F")
    return t.orders.select(
        k.alias("id"), y.alias("y"), (((k * 7919) % 701 + 299 * y) / F.lit(1000.0)).alias("signal"),
        (((k * 104729) % 1001) / F.lit(1000.0)).alias("noise"), (k % 10).cast("int").alias("fold"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Laser").otherwise("Traditional").alias("arm"))


# continuous scores with few ties: one distinct value per row or so
DENSE = """dense AS (
  SELECT o_orderkey AS id, (o_orderstatus = 'F')::INT AS y, o_totalprice / 1e6 AS p FROM orders)"""


def dense(t: Tables) -> DataFrame:
    return t.orders.select(key().alias("id"), _flag(F.col("o_orderstatus") == "F").alias("y"),
                           (F.col("o_totalprice") / F.lit(1e6)).alias("p"))


DIMS = [f"d{i}" for i in range(13)]  # as many as a clinical model has features
ML = "ml AS (SELECT vec_id, (label IN (0, 1, 2))::INT AS y, " + ", ".join(
    f"embedding[{i + 1}]::DOUBLE AS {d}" for i, d in enumerate(DIMS)) + " FROM embeddings)"


def ml(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", _flag(F.col("label").isin(0, 1, 2)).alias("y"),
                               *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(DIMS)])


RUNS = """runs AS (
  SELECT event_type AS experiment, event_id::VARCHAR AS run_id,
    concat(CASE user_id % 3 WHEN 0 THEN 'lr' WHEN 1 THEN 'rf' ELSE 'svm' END, '_',
           CASE user_id % 2 WHEN 0 THEN 'orig' ELSE 'smote' END, '_training') AS run_name,
    ts AS start_time, value FROM events)"""


# runs of which every second one was logged again
RERUNS = RUNS.replace("runs AS", "logged AS") + """, runs AS (
  SELECT * EXCLUDE (value), CASE WHEN run_id::BIGINT % 2 = 0 THEN 100 - value ELSE value END AS value FROM logged)"""


def runs(t: Tables) -> DataFrame:
    u = F.col("user_id")
    family = F.when(u % 3 == 0, "lr").when(u % 3 == 1, "rf").otherwise("svm")
    sampling = F.when(u % 2 == 0, "orig").otherwise("smote")
    return t.events.select(F.col("event_type").alias("experiment"), F.col("event_id").cast("string").alias("run_id"),
                           F.concat_ws("_", family, sampling, F.lit("training")).alias("run_name"),
                           F.col("ts").alias("start_time"), "value")


# Raw clinical headers over the orders table.
_CLINICAL = [
    ("ID", "o_orderkey", lambda k, c: k),
    ("Birthday", "o_orderdate::DATE", lambda k, c: F.col("o_orderdate").cast("date")),
    ("Age (y)", "(o_custkey % 83 + 10)::VARCHAR", lambda k, c: (c % 83 + 10).cast("string")),
    ("Height (m)", "1.5e0 + (o_orderkey % 45) / 100e0", lambda k, c: F.lit(1.5) + (k % 45) / F.lit(100.0)),
    ("Weight (Kg)", "(45 + o_orderkey % 80)::DOUBLE", lambda k, c: (45 + k % 80).cast("double")),
    ("Geographical Origin", "CASE o_custkey % 3 WHEN 0 THEN 'Marocco' WHEN 1 THEN 'Italy' ELSE 'Tunisia' END",
     lambda k, c: F.when(c % 3 == 0, "Marocco").when(c % 3 == 1, "Italy").otherwise("Tunisia")),
    ("Comorbidities", "CASE o_orderkey % 7 WHEN 0 THEN 'DM2' WHEN 1 THEN 'htn, dm' WHEN 3 THEN 'HTN' ELSE '0' END",
     lambda k, c: F.when(k % 7 == 0, "DM2").when(k % 7 == 1, "htn, dm").when(k % 7 == 3, "HTN").otherwise("0")),
    ("Preoperative Blood Pressure (mmHg)", "concat(110 + o_orderkey % 40, '/', 65 + o_orderkey % 20)",
     lambda k, c: F.concat((110 + k % 40).cast("string"), F.lit("/"), (65 + k % 20).cast("string"))),
    ("Preoperative Heart Rate (bpm)", "(60 + o_orderkey % 41)::DOUBLE", lambda k, c: (60 + k % 41).cast("double")),
    ("Surgical Technique", "CASE WHEN o_orderstatus = 'F' THEN 'Traditional' ELSE 'Laser' END",
     lambda k, c: F.when(F.col("o_orderstatus") == "F", "Traditional").otherwise("Laser")),
    ("Anesthesia Type", "CASE o_orderkey % 2 WHEN 0 THEN 'lidocaine' ELSE 'carbocaine' END",
     lambda k, c: F.when(k % 2 == 0, "lidocaine").otherwise("carbocaine")),
    ("Intraoperative Blood Loss (ml)", "(o_orderkey % 31)::DOUBLE", lambda k, c: (k % 31).cast("double")),
    ("Intraoperative Mean Blood Pressure (mmHg)", "concat(100 + o_orderkey % 60, '/', 60 + o_orderkey % 40)",
     lambda k, c: F.concat((100 + k % 60).cast("string"), F.lit("/"), (60 + k % 40).cast("string"))),
    ("Intraoperative Mean Pulse Oxymetry (%)", "CASE WHEN o_orderkey % 100 = 0 THEN 97e0 ELSE 98e0 END",
     lambda k, c: F.when(k % 100 == 0, 97.0).otherwise(98.0)),
    ("Surgical Time (min)", "(20 + o_orderkey % 70)::VARCHAR", lambda k, c: (20 + k % 70).cast("string")),
    ("Functional Outcomes (pain)", "(o_orderkey % 5 = 0)::INT", lambda k, c: _flag(k % 5 == 0)),
    ("Functional Outcomes (Bleeding)", "(o_orderkey % 11 = 0)::INT", lambda k, c: _flag(k % 11 == 0)),
    ("Functional Outcomes (Edema)", "(o_orderkey % 97 = 0)::INT", lambda k, c: _flag(k % 97 == 0)),
    ("Functional Outcomes (Infection)", "(o_orderkey % 17 = 0)::INT", lambda k, c: _flag(k % 17 == 0)),
    ("Cost of Procedure (€)", "o_totalprice", lambda k, c: F.col("o_totalprice")),
    ("Cost Type", "o_orderpriority", lambda k, c: F.col("o_orderpriority")),
]
CLINICAL = "clinical AS (SELECT o_orderkey AS patient_id, " + ", ".join(
    f'{sql} AS "{name}"' for name, sql, _ in _CLINICAL) + " FROM orders)"


def clinical(t: Tables) -> DataFrame:
    k, c = key(), F.col("o_custkey")
    return t.orders.select(k.alias("patient_id"), *[build(k, c).alias(name) for name, _, build in _CLINICAL])
