"""People's decisions: review transitions, feedback, checks of written pages, handover text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: State, action, next state.
TRANSITIONS = [("draft", "edit", "draft"), ("draft", "approve", "approved"), ("draft", "return", "returned"), ("returned", "edit", "draft"), ("approved", "edit", "draft"), ("approved", "return", "returned")]


def page_states(log: DataFrame) -> DataFrame:
    """(slug, status, version, refused) of each page from its log (slug, at, action): actions that a state does not allow are counted, not done."""
    table = F.create_map(*[F.lit(x) for s, a, n in TRANSITIONS for x in (f"{s}/{a}", n)])
    start = F.struct(F.lit("draft").alias("status"), F.lit(0).alias("version"), F.lit(0).alias("refused"))

    def step(s: Column, r: Column) -> Column:
        new = F.try_element_at(table, F.concat_ws("/", s["status"], r["action"]))
        return F.struct(F.coalesce(new, s["status"]).alias("status"), (s["version"] + F.when(new.isNotNull() & (r["action"] == "edit"), 1).otherwise(0)).alias("version"), (s["refused"] + new.isNull().cast("int")).alias("refused"))

    rows = log.groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("at", "action"))).alias("log"))
    return rows.select("slug", F.aggregate("log", start, step).alias("s")).select("slug", "s.*")


def with_feedback(records: DataFrame, feedback: DataFrame) -> DataFrame:
    """Recorded (well_id, formation, hazard) with those that people reported as problems: for base rates only, never for test labels."""
    said = feedback.where("verdict = 'problem'").select("well_id", "formation", "hazard")
    return records.select("well_id", "formation", "hazard").union(said).distinct()


def reviewed(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events (source_ref, hazard, needs_review, ...) after decisions (at, decision, source_ref, hazard, new_hazard); the last one for each key counts."""
    last = decisions.groupBy("source_ref", "hazard").agg(F.max_by(F.struct("decision", "new_hazard"), "at").alias("_d"))
    rows = events.join(last, ["source_ref", "hazard"], "left").where(~F.col("_d.decision").eqNullSafe("reject"))
    hazard = F.when(F.col("_d.decision") == "relabel", F.col("_d.new_hazard")).otherwise(F.col("hazard"))
    method = F.when(F.col("_d").isNotNull(), "human").otherwise(F.col("method")) if "method" in events.columns else F.when(F.col("_d").isNotNull(), "human")
    rest = [c for c in events.columns if c not in ("hazard", "needs_review", "method")]
    return rows.select(*rest, hazard.alias("hazard"), (F.col("needs_review") & F.col("_d").isNull()).alias("needs_review"), method.alias("method"))


def stale_decisions(events: DataFrame, decisions: DataFrame) -> DataFrame:
    return decisions.join(events.select("source_ref", "hazard"), ["source_ref", "hazard"], "left_anti")


def uncited_lines(pages: DataFrame) -> DataFrame:
    """Lines of pages (slug, text) that state something and do not end with a source mark ``[^sN]``; headings, rules and blank lines state nothing."""
    lines = pages.select("slug", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    content = (F.trim("line") != "") & ~F.col("line").rlike(r"^\s*(#|---|\||\[\^s\d+\]:)")
    return lines.where(content & ~F.col("line").rlike(r"\[\^s\d+\]\.?\s*$"))


def unsupported_numbers(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(slug, sentence, numbers): numbers of a page's sentences (slug, sentence) that none of its sources (slug, text) holds."""
    norm = lambda c: F.transform(F.regexp_extract_all(F.regexp_replace(c, r"(?<=\d),(?=\d{3}\b)", ""), F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)")), lambda n: n.cast("double"))
    allowed = sources.groupBy("slug").agg(F.array_distinct(F.flatten(F.collect_list(norm(F.col("text"))))).alias("allowed"))  # a page's own sources
    rows = pages.select("slug", "sentence", norm(F.regexp_replace("sentence", r"\[\^s\d+\]", "")).alias("found")).join(allowed, "slug", "left")
    rows = rows.withColumn("numbers", F.array_except("found", F.coalesce("allowed", F.array().cast("array<double>"))))
    return rows.where(F.size("numbers") > 0).select("slug", "sentence", "numbers")


def quoted(answers: DataFrame) -> DataFrame:
    """Model answers (text, hazard, evidence_span, confidence) that may be used: a span found word for word, a confidence from 0 to 1."""
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    span = squeeze(F.col("evidence_span"))
    return answers.where((F.length(span) > 0) & squeeze(F.col("text")).contains(span) & F.col("confidence").between(0, 1))


def new_texts(passages: DataFrame, embedded: DataFrame) -> DataFrame:
    """Passages (passage_id, text) whose fingerprint has no vector yet."""
    keyed = passages.withColumn("text_fp", F.sha2(F.coalesce("text", F.lit("")), 256))
    return keyed.join(embedded.select("text_fp"), "text_fp", "left_anti")


def handover(alerts: DataFrame, most: int = 4) -> DataFrame:
    """(well_id, text): the shift's note from alerts (well_id, hazard, formation, level, mean, top, fix), the gravest first."""
    order = Window.partitionBy("well_id").orderBy(F.col("level") != "alert", F.col("mean").desc(), "top", "hazard")
    rows = alerts.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most)
    line = F.format_string("%d. %s in %s from %.0f m (%s, %.0f %%)%s", "i", F.replace("hazard", F.lit("_"), F.lit(" ")), "formation", "top", "level", F.col("mean") * 100, F.coalesce(F.concat(F.lit("; "), "fix"), F.lit("")))
    return rows.groupBy("well_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
