"""A demonstration store made from scored images: patients, their analyses, most of them verified."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortal.operators import classify as C
from cohortal.operators.prefix import numbered, running_totals
from cohortal.session import materialize

DAY_MS = 86_400_000
#: Images of a patient, each as likely as the others.
SIZES = (1, 2, 2, 3, 3, 4, 5)
ANTECEDENTS = (None, None, "family history", "many nevi", "sun damage", "earlier excision", "fair skin")
#: Every so many-th analysis stays unverified.
UNVERIFIED = 13


def draw(seed: int, what: str, *key: Column | str) -> Column:
    """A number below 2 ** 32 from the MD5 of its purpose and key, as any engine computes it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{what}"), *key)), 1, 8), 16, 10).cast("long")


def pick(values: Sequence, number: Column) -> Column:
    kind = "int" if isinstance(values[0], int) else "string"
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def demo_store(images: DataFrame, id: str, probabilities: Sequence[str], truth: str, coverage: str, now_ms: int, seed: int = 42) -> dict[str, DataFrame]:
    """``patient``, ``analysis`` and ``verified_label`` of a store in which images, in a seeded order, belong to patients of 1 to 5.

    Sizes of patients are drawn for as many as there can be and summed; each image finds the patient that
    its place falls to by a join on the place. A patient's images were taken on days of a window of 45 to 650 days, in
    order. Every 13th analysis has no label. Counts, sums and numbers are all made in parts.
    """
    shuffled = numbered(images.withColumn("_o", draw(seed, "order", F.col(id).cast("string"))), [F.col("_o"), F.col(id)], "_place")
    shuffled = materialize(shuffled.drop("_o"))
    n = shuffled.count()
    sizes = images.sparkSession.range(n).select(F.col("id").alias("_p"), pick(SIZES, draw(seed, "size", F.col("id").cast("string"))).cast("long").alias("_n"))
    spans = running_totals(sizes, [F.col("_p")], {"_end": F.col("_n")}).where(F.col("_end") - F.col("_n") < n)
    key = F.col("_p").cast("string")
    window = 45 + F.pmod(draw(seed, "window", key), F.lit(606))
    people = materialize(spans.select("_p", "_end", (F.least("_end", F.lit(n)) - F.col("_end") + F.col("_n")).alias("_n"), (F.col("_end") - F.col("_n")).alias("_first"), window.alias("_window")))
    start = F.lit(now_ms) - F.col("_window") * DAY_MS
    name = lambda p: F.concat(F.lit("p_demo"), F.lpad(p.cast("string"), 9, "0"))
    patient = people.select(
        name(F.col("_p")).alias("id"), F.concat(F.lit("Patient "), key).alias("name"), F.pmod(draw(seed, "sex", key), F.lit(2)).cast("int").alias("sex"),
        F.pmod(draw(seed, "sun", key), F.lit(4)).cast("int").alias("sun_exposure"), pick(ANTECEDENTS, draw(seed, "antecedents", key)).alias("antecedents"), start.alias("created_ts"), start.alias("updated_ts"),
    )
    # The days of a patient in order: at most five numbers.
    day = lambda i: F.pmod(draw(seed, "day", key, i.cast("string")), F.col("_window") + 1)
    days = F.array_sort(F.transform(F.sequence(F.lit(1).cast("long"), F.col("_n")), day))
    places = people.select("_p", "_window", F.posexplode(days).alias("_i", "_day"), "_first").select("_p", (F.col("_first") + F.col("_i") + 1).alias("_place"), (start + F.col("_day") * DAY_MS).alias("ts"))
    rows = shuffled.join(places, "_place")
    nevus, mel, atyp = (F.col(c) for c in probabilities)
    cuts = [F.lit(C.THRESHOLDS[k]) for k in ("melanoma", "atypical")]
    own = F.concat(F.lit("a_demo"), F.lpad(F.col("_place").cast("string"), 12, "0"))
    analysis = rows.select(
        own.alias("id"), "ts", name(F.col("_p")).alias("patient_id"), F.col("ts").alias("capture_date"), F.col(id).alias("image_id"), C.argmax(F.array(nevus, mel, atyp)).alias("pred_class"),
        nevus.alias("score_nevus"), mel.alias("score_mel"), atyp.alias("score_atyp"), C.verdict(mel, atyp, *cuts).alias("verdict"), C.non_benign(mel, atyp, *cuts).cast("int").alias("non_benign"),
        C.low_quality(F.col(coverage)).cast("int").alias("quality_flag"), F.lit(0).alias("archived"),
    )
    verified = rows.where(F.col("_place") % UNVERIFIED != 0)
    label = verified.select(F.col("_place").alias("id"), own.alias("analysis_id"), "ts", F.when(F.col(truth) == 1, 1).otherwise(0).alias("verified_class"), F.lit("biopsy").alias("source"))
    return {"patient": patient, "analysis": analysis, "verified_label": label}
