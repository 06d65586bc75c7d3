"""Questions in plain words: which wells, layers and places they name, which problems they speak of, and what they want to know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borelog.functions import taxonomy as tax

#: Words that ask about a problem without naming it in full; callers may pass their own.
SYNONYMS = {"cementing_issue": ["cement"], "fishing": ["fish"], "lost_circulation": ["loss"], "stuck_pipe": ["tight"], "torque_spike": ["torque"], "wellbore_instability": ["instability", "unstable"]}
#: What a question wants, by its words.
INTENTS = {
    "ledger": ["worked", "works", "helped", "fix*", "cure*", "remed*", "mitigat*", "solution*", "how to", "was done"],
    "nearby": ["near", "nearby", "around", "close to", "offset*", "within", "in a radius"],
    "mud_window": ["mud weight*", "mud window*", "density", "ppg", "leak off"],
    "hazard": ["chance*", "likel*", "risk*", "probab*", "how often", "expect*"],
}


def words(text: Column) -> Column:
    """Lower-cased words; a name's own signs stay in it."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}#/_-]+"), F.lit(0))


def named(questions: DataFrame, entities: DataFrame, question_id: str, text: str = "text") -> DataFrame:
    """(question, names: array of kind, id, name in the order of the text) of ``entities`` (kind, id, name) that each question names in whole words.

    The longest name is taken first, and no word serves two names; of two entities with one name both are given. The
    questions' runs of words meet the names by equality, for each length that a name has."""
    keyed = entities.withColumn("_w", words(F.col("name"))).where(F.size("_w") > 0).select(F.struct("kind", F.col("id").cast("string").alias("id"), "name").alias("_who"), F.size("_w").alias("_n"), F.array_join("_w", " ").alias("_key"))
    sizes = [r["_n"] for r in keyed.select("_n").distinct().collect()]  # lengths of names in words: a few
    asked = questions.select(question_id, words(F.col(text)).alias("_w"))
    if not sizes:
        return asked.select(question_id, F.lit(None).cast("array<struct<kind:string,id:string,name:string>>").alias("names"))

    def runs(n: int) -> Column:
        one = F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("_w", i + 1, n), " ").alias("key")))
        return F.when(F.size("_w") >= n, one).otherwise(F.array())

    spots = asked.select(question_id, F.explode(F.flatten(F.array(*map(runs, sizes)))).alias("r")).select(question_id, "r.at", "r.n", F.col("r.key").alias("_key"))
    found = spots.join(keyed.drop("_n"), "_key").groupBy(question_id, "at", "n").agg(F.sort_array(F.collect_list("_who")).alias("who"))
    spot = F.struct((-F.col("n")).alias("order"), "at", "n", "who")
    each = found.groupBy(question_id).agg(F.sort_array(F.collect_list(spot)).alias("spots"))  # bounded by the question's words

    def take(held: Column, s: Column) -> Column:
        free = ~F.exists(held, lambda h: (s["at"] < h["at"] + h["n"]) & (h["at"] < s["at"] + s["n"]))
        return F.when(free, F.concat(held, F.array(F.struct(s["at"].alias("at"), s["n"].alias("n"), s["who"].alias("who"))))).otherwise(held)

    none = F.filter(F.transform("spots", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), s["who"].alias("who"))), lambda s: F.lit(False))
    taken = F.array_sort(F.aggregate("spots", none, take), lambda a, b: F.when(a["at"] < b["at"], -1).otherwise(1))
    return asked.select(question_id).join(each.select(question_id, F.flatten(F.transform(taken, lambda s: s["who"])).alias("names")), question_id, "left")


def problems(text: Column, taxonomy: dict | None = None, synonyms: dict[str, list[str]] | None = None) -> Column:
    """The problems that a question speaks of, denied or not, sorted."""
    more = SYNONYMS if synonyms is None else synonyms
    said = {k: text.rlike(tax.any_of([*p["say"], *more.get(k, []), k.replace("_", " ")])) for k, p in (taxonomy or tax.HAZARDS).items()}
    return F.array_sort(F.array_compact(F.array(*[F.when(hit, F.lit(k)) for k, hit in said.items()])))


def intents(text: Column, phrases: dict[str, list[str]] | None = None) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(tax.any_of(p)), F.lit(k)) for k, p in (phrases or INTENTS).items()]))


def parse(questions: DataFrame, entities: DataFrame, question_id: str, text: str = "text") -> DataFrame:
    """(question, names, hazards, intents); nothing found gives empty arrays, a null text too."""
    said = questions.select(question_id, problems(F.col(text)).alias("hazards"), intents(F.col(text)).alias("intents"))
    return named(questions, entities, question_id, text).withColumn("names", F.coalesce("names", F.array())).join(said, question_id)
