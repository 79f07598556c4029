"""Hospital-style entities derived from the star-schema test tables.

The library's functions take these entities as DataFrames; a user passes their
own tables instead. Flags, NULLs and times of day come from the rows' own
values, so the semantics that depend on them are exercised.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carecycle.functions.vocab import ANNOTATION_FEATURES, COMORBIDITIES
from carecycle.sources.tables import read_table


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def _yes_no(condition: Column) -> Column:
    return F.when(condition, "Y").otherwise("N")


def _once(view):
    """Builds a view's plan at the first call and gives the same frame again afterwards."""

    @wraps(view)
    def of(self):
        return self.shared(view.__name__, lambda: view(self))

    return of


class Analogs:
    """Entity views over one folder of test tables; plans, not data, are kept."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._built: dict[object, DataFrame] = {}

    def shared(self, key: object, build: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._built:
            self._built[key] = build()
        return self._built[key]

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @_once
    def admissions(self) -> DataFrame:
        """One row per order; the hour of day comes from the order key."""
        admit = F.col("o_orderdate") + _hours(F.col("o_orderkey") % 24)
        return self.table("orders").select(
            F.col("o_custkey").alias("subject_id"),
            F.col("o_orderkey").alias("hadm_id"),
            admit.alias("admit_dt"),
            (admit + _minutes(F.floor(F.col("o_totalprice") / 20))).alias("disch_dt"),
        )

    @_once
    def patients(self) -> DataFrame:
        whole = F.floor("c_acctbal").cast("int")
        died = F.col("c_acctbal") < 2500
        return self.table("customer").select(
            F.col("c_custkey").alias("subject_id"),
            F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F").alias("gender"),
            F.date_add(F.lit("1985-01-01").cast("date"), -5 * whole).alias("dob"),
            F.when(died, F.date_add(F.lit("1998-06-01").cast("date"), whole)).alias("dod"),
            _yes_no(died).alias("expire_flg"),
        )

    @_once
    def stays(self) -> DataFrame:
        """One row per (order, line number); the smallest ones have no admission id."""
        flag = lambda c: F.max(F.when(c, 1).otherwise(0))
        lines = (
            self.table("lineitem")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.sum("l_quantity").alias("qty"),
                F.max("l_discount").alias("disc"),
                F.max("l_tax").alias("tax"),
                flag(F.col("l_returnflag") == "A").alias("a"),
                flag(F.col("l_returnflag") == "N").alias("n"),
                flag(F.col("l_linestatus") == "F").alias("f"),
            )
        )
        joined = lines.join(
            self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")
        ).join(
            self.patients(), F.col("o_custkey") == F.col("subject_id")
        )
        linked = F.col("qty") > 2
        quarter = (F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate")
        admit = F.col("o_orderdate") + _hours(F.col("o_orderkey") % 24)
        hospital_los = F.floor(F.col("o_totalprice") / 20)
        los = F.col("qty") * 100.0
        intime = admit + F.make_dt_interval(F.col("l_linenumber") - 1)
        age = F.date_diff(intime.cast("date"), F.col("dob")) / 365.25
        return joined.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("icustay_id"),
            "subject_id",
            F.when(linked, F.col("l_orderkey")).alias("hadm_id"),
            "gender",
            "dob",
            "dod",
            "expire_flg",
            ((quarter - 1) * 7 + F.col("l_linenumber")).alias("subject_icustay_seq"),
            F.when(linked, quarter).alias("hospital_seq"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Y")
            .when(F.col("o_orderpriority") != "5-LOW", "N")
            .alias("hospital_last_flg"),
            F.when(linked, admit).alias("hospital_admit_dt"),
            F.when(linked, admit + _minutes(hospital_los)).alias("hospital_disch_dt"),
            F.when(linked, hospital_los.cast("double")).alias("hospital_los"),
            F.when(F.col("o_orderstatus") == "F", "Y")
            .when(F.col("o_orderstatus") == "O", "N")
            .alias("hospital_expire_flg"),
            F.col("l_linenumber").alias("icustay_seq"),
            _yes_no(F.col("n") == 0).alias("icustay_last_flg"),
            intime.alias("icustay_intime"),
            (intime + _minutes(los)).alias("icustay_outtime"),
            age.alias("icustay_admit_age"),
            F.when(age < 1, "neonate").when(age < 16, "middle").otherwise("adult").alias(
                "icustay_age_group"
            ),
            los.alias("icustay_los"),
            _yes_no((F.col("f") == 1) & (F.col("a") == 1)).alias("icustay_expire_flg"),
            F.when(F.col("a") == 1, "MICU")
            .when(F.col("n") == 1, "SICU")
            .otherwise("CCU")
            .alias("icustay_first_careunit"),
            F.when(F.col("f") == 1, "MED").otherwise("SURG").alias("icustay_first_service"),
            F.when(F.col("n") == 1, "MED").otherwise("SURG").alias("icustay_last_service"),
            F.when(F.col("tax") > 0.005, F.round(F.col("disc") * 100).cast("int")).alias(
                "sofa_first"
            ),
            F.when(F.col("tax") < 0.075, F.col("qty").cast("int")).alias("sapsi_first"),
        )

    @_once
    def demographics(self) -> DataFrame:
        people = (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        )
        group = F.col("c_nationkey") % 5
        return (
            self.table("orders")
            .join(people, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                F.col("o_custkey").alias("subject_id"),
                F.col("o_orderkey").alias("hadm_id"),
                F.col("c_mktsegment").alias("overall_payor_group_descr"),
                F.col("o_orderpriority").alias("admission_type_descr"),
                F.col("o_orderstatus").alias("admission_source_descr"),
                F.when(group == 0, "MARRIED")
                .when(group == 1, "SINGLE")
                .when(group == 2, "WIDOWED")
                .when(group == 3, "UNKNOWN")
                .alias("marital_status_descr"),
                F.col("r_name").alias("ethnicity_descr"),
                F.col("n_name").alias("religion_descr"),
            )
        )

    @_once
    def comorbidities(self) -> DataFrame:
        """30 flags per order: 25 from the brands of its parts, 5 from the types."""
        types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]
        conditions = [F.col("p_brand") == f"Brand#{i}" for i in range(1, 26)]
        conditions += [F.col("p_type") == t for t in types]
        # A part's flags are the bits of one number, so orders combine a single column.
        bits = reduce(Column.bitwiseOR, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)])
        per_order = (
            self.table("lineitem")
            .join(self.table("part").select("p_partkey", bits.alias("_bits")), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("l_orderkey")
            .agg(F.bit_or("_bits").alias("_bits"))
        )
        return per_order.join(
            self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")
        ).select(
            F.col("o_custkey").alias("subject_id"),
            F.col("l_orderkey").alias("hadm_id"),
            *[F.getbit("_bits", F.lit(i)).cast("int").alias(name) for i, name in enumerate(COMORBIDITIES)],
        )

    @_once
    def _coded_lines(self) -> DataFrame:
        return self.table("lineitem").join(
            self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")
        )

    @_once
    def diagnoses(self) -> DataFrame:
        return (
            self._coded_lines()
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("o_custkey").alias("subject_id"),
                F.col("l_orderkey").alias("hadm_id"),
                F.col("l_linenumber").alias("sequence"),
                F.concat_ws(".", "p_brand", "p_size").alias("code"),
                F.concat_ws(" ", "p_type", "p_name").alias("description"),
            )
        )

    @_once
    def diagnosis_names(self) -> DataFrame:
        """Code dimension: one description per undotted code."""
        return (
            self.table("part")
            .groupBy(F.col("p_brand").alias("code"))
            .agg(F.concat(F.lit("about "), F.lower(F.col("p_brand"))).alias("description"))
        )

    @_once
    def cost_events(self) -> DataFrame:
        return self._coded_lines().select(
            F.col("o_custkey").alias("subject_id"),
            F.col("l_orderkey").alias("hadm_id"),
            F.col("l_partkey").alias("itemid"),
            F.when(F.col("l_discount") > 0, F.col("l_extendedprice").cast("decimal(12,2)")).alias(
                "cost_weight"
            ),
        )

    @_once
    def cost_items(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("itemid"), F.col("p_name").alias("description")
        )

    @_once
    def procedures(self) -> DataFrame:
        return self._coded_lines().select(
            F.col("o_custkey").alias("subject_id"),
            F.col("l_orderkey").alias("hadm_id"),
            F.col("l_suppkey").alias("itemid"),
        )

    @_once
    def procedure_items(self) -> DataFrame:
        """Suppliers in credit only, so that some procedures have no name."""
        return self.table("supplier").filter("s_acctbal > 0").select(
            F.col("s_suppkey").alias("itemid"), F.col("s_name").alias("description")
        )

    @_once
    def monitored_stays(self) -> DataFrame:
        """One stay per customer, matching the users of the event table."""
        return self.table("customer").select(
            F.col("c_custkey").alias("icustay_id"),
            F.floor(F.col("c_custkey") / 3).alias("subject_id"),
            (F.col("c_custkey") * 10).alias("hadm_id"),
            F.when(F.col("c_acctbal") < -660, "neonate").otherwise("adult").alias(
                "icustay_age_group"
            ),
        )

    @_once
    def chart_events(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("icustay_id"),
            F.col("event_type").alias("itemid"),
            F.col("ts").alias("charttime"),
        )

    @_once
    def medication_events(self) -> DataFrame:
        """Small values become a zero or a negative dose."""
        value = F.col("value")
        return self.table("events").select(
            F.col("user_id").alias("icustay_id"),
            F.col("event_type").alias("itemid"),
            F.col("ts").alias("charttime"),
            F.when(value < 5, 0.0).when(value < 10, -value).otherwise(value).alias("dose"),
        )

    @_once
    def notes(self) -> DataFrame:
        """Four documents per admission, eight per subject; French ones have no admission."""
        kind = F.substring("source", 4, 10).cast("int")
        return self.table("documents").select(
            F.col("doc_id").alias("note_id"),
            F.floor(F.col("doc_id") / 8).alias("subject_id"),
            F.when(F.col("lang") != "fr", F.floor(F.col("doc_id") / 4)).alias("hadm_id"),
            (F.floor(F.col("doc_id") / 4) * 8 + 1 + F.col("doc_id") % 7).alias("icustay_id"),
            (F.lit("2000-01-01").cast("timestamp_ntz") + _minutes(F.col("n_chars"))).alias(
                "charttime"
            ),
            F.when(kind < 5, "DISCHARGE_SUMMARY")
            .when(kind < 10, "MD Notes")
            .otherwise("Nursing/Other")
            .alias("category"),
            F.when(F.col("lang") == "de", "Discharge Planning")
            .when(F.col("lang") != "es", "Note")
            .alias("title"),
            "text",
        )

    @_once
    def note_stays(self) -> DataFrame:
        """Every document as a note on the stays of fifteen orders."""
        order = F.explode(F.sequence(F.col("doc_id") * 15, F.col("doc_id") * 15 + 14))
        links = self.table("documents").select(F.col("doc_id").alias("note_id"), order.alias("key"))
        links = links.withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(7))))
        return links.select("note_id", (F.col("key") * 8 + F.col("line")).alias("icustay_id"))

    @_once
    def annotations(self) -> DataFrame:
        """Result rows of six operators over seven batches; notes are orders."""
        ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
        day = F.date_format("l_shipdate", "yyyy-MM-dd")
        features = [
            F.when((F.col("l_partkey") + i) % (i + 2) == 0, 1).otherwise(0).alias(name)
            for i, name in enumerate(ANNOTATION_FEATURES)
        ]
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("subject_id"),
            F.col("l_orderkey").alias("hadm_id"),
            (F.col("l_orderkey") * 2).alias("icu_id"),
            F.lit("dis").alias("note_type"),
            day.alias("chart_time"),
            F.lit("Discharge").alias("category"),
            F.date_format("l_shipdate", "MM/dd/yyyy").alias("real_time"),
            *features,
            F.concat_ws("-", "l_returnflag", "l_linestatus").alias("operator"),
            F.concat(F.lit("bat"), F.lpad(F.col("l_linenumber").cast("string"), 7, "0")).alias(
                "batch_id"
            ),
            F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], day)).alias(
                "annotation_id"
            ),
        )

    @_once
    def annotated_notes(self) -> DataFrame:
        """Note texts by admission and batch, as handed to the annotators."""
        return self.table("documents").select(
            (F.col("doc_id") * 3).alias("subject_id"),
            F.col("doc_id").alias("hadm_id"),
            F.lit("Discharge").alias("category"),
            "text",
            F.when(F.col("lang") == "en", 1).otherwise(0).alias("cohort"),
            F.concat(F.lit("bat000000"), (F.col("doc_id") % 7 + 1).cast("string")).alias(
                "batch_id"
            ),
        )
