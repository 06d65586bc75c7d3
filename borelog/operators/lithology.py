"""Rock classes from words, votes around a name, analog intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borelog.functions import geo

#: Rock classes and the words that name them.
CLASSES = {
    "sandstone": ["sandstone", "sands"],
    "shale": ["shale", "mudstone", "siltstone", "silt", "claystone/shale"],
    "claystone": ["claystone", "clay", "clay-siltstone"],
    "limestone": ["limestone", "carbonate", "dolomite", "dolostone", "calcareous"],
    "chalk": ["chalk"],
    "marl": ["marl", "marlstone"],
    "coal": ["coal"],
    "salt": ["salt", "anhydrite", "halite", "evaporite", "gypsum"],
    "basement": ["basement", "granite", "granitoid", "granodiorite", "basalt", "tonalite", "gneiss", "schist"],
    "mixed": ["tuff", "volcanic", "breccia"],
}
#: Short rock codes of curated unit maps.
UNIT_CODES = {"sand": "sandstone", "shale": "shale", "lime": "limestone", "clay": "claystone", "chalk": "chalk"}


def _word(text: Column, words: list[str], plural: bool = False) -> Column:
    return text.rlike(r"(?iu)\b(?:" + "|".join(rf"\Q{w}\E" for w in words) + (r")(?:s|es)?\b" if plural else r")\b"))


def _named(text: Column, plural: bool = False) -> Column:
    """The classes whose words stand in ``text``."""
    return F.array_compact(F.array(*[F.when(_word(text, w, plural), F.lit(k)) for k, w in CLASSES.items()]))


def rock_class(text: Column, unit_code: Column | None = None) -> Column:
    """The class of a unit: that of its code in a curated map, else the one that its description names; ``mixed`` for several; null for none, never a guess."""
    found = _named(text)
    said = F.when(F.size(found) > 1, "mixed").otherwise(F.get(found, F.lit(0)))
    if unit_code is None:
        return said
    return F.coalesce(F.create_map(*[F.lit(x) for pair in UNIT_CODES.items() for x in pair])[unit_code], said)


def mentions(passages: DataFrame, names: list[str], window: int = 60) -> DataFrame:
    """Every mention of each name (all columns of ``passages``, name, spot, after): what follows it, at most ``window`` characters and not past another of ``names``.

    The text is cut behind each place where one of the names ends, so mentions may stand as near each other as they like."""
    longest = sorted(names, key=len, reverse=True)
    any_name = r"(?iu)(?<!\w)(?:" + "|".join(rf"\Q{n}\E" for n in longest) + r")(?!\w)"
    rows = passages.where(F.col("text").rlike(any_name))
    pieces = F.split(F.col("text"), any_name, -1)
    said = F.regexp_extract_all(F.col("text"), F.lit(any_name), F.lit(0))
    by_low = F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)])
    spots = F.transform(F.sequence(F.lit(0), F.size(said) - 1), lambda i: F.struct(by_low[F.lower(said[i])].alias("name"), i.alias("spot"), F.substring(pieces[i + 1], 1, window).alias("after")))
    return rows.withColumn("_m", F.explode(spots)).select(*passages.columns, "_m.*")


def votes(passages: DataFrame, names: list[str], window: int = 60, mixed: float = 0.5) -> DataFrame:
    """(name, rock, n): the class most often named right after each name; ``mixed`` where the second has ``mixed`` times as many or more, of two as often the first in the alphabet.

    A mention gives one vote to each class that it names, in the singular or plural."""
    each = mentions(passages, names, window).select("name", F.explode(_named(F.col("after"), plural=True)).alias("rock"))
    counts = each.groupBy("name", "rock").agg(F.count("*").alias("n"))
    ranked = counts.groupBy("name").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "rock", "n"))).alias("r"))  # as many entries as classes
    second = F.coalesce(F.get("r", F.lit(1))["n"], F.lit(0))
    return ranked.select("name", F.when(second >= mixed * F.col("r")[0]["n"], "mixed").otherwise(F.col("r")[0]["rock"]).alias("rock"), F.col("r")[0]["n"].alias("n"))


def analogs(intervals: DataFrame, asked: DataFrame, least: float = 10.0) -> DataFrame:
    """Intervals (well_id, rock, top, base) that share ``least`` metres or more with an asked band (rock, lo, hi) of the same class; ``weight`` is the well's largest share."""
    ov = geo.overlap(F.col("lo"), F.col("hi"), F.col("top"), F.col("base"))
    rows = intervals.join(asked, "rock").where((F.col("top") < F.col("hi")) & (F.col("base") > F.col("lo"))).withColumn("_ov", ov).where(F.col("_ov") >= least)
    return rows.groupBy("rock", "lo", "hi", "well_id").agg(F.max(F.least(F.lit(1.0), F.col("_ov") / (F.col("base") - F.col("top")))).alias("weight"), F.count("*").alias("intervals"))


#: Other names of the classes; callers may pass their own.
ALIASES = {
    "carbonate": "limestone", "carbonates": "limestone", "dolomite": "limestone", "dolostone": "limestone", "evaporite": "salt", "evaporites": "salt", "granite": "basement", "igneous": "basement",
    "metamorphic": "basement", "claystones": "claystone", "shales": "shale", "sandstones": "sandstone", "mudstone": "shale", "siltstone": "shale",
}
#: Ages, with what may stand before them.
AGE = r"(?:(?:Upper|Lower|Middle|Late|Early)\s+)?(?:Precambrian|Cretaceous|Palaeocene|Paleocene|Eocene|Oligocene|Miocene|Pliocene|Pleistocene)"
DEPTH_HINT = r"(\d[\d,]{2,6}(?:\.\d+)?)\s*(?:m|metres?|meters?)\b"


def canonical_class(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """A class's own name for what a user wrote, in any case; null for anything else."""
    known = {k: k for k in CLASSES} | (ALIASES if aliases is None else aliases)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return table[F.lower(F.trim(name))]


def nearest_age(text: Column, name: str, window: int = 40) -> Column:
    """The age word that stands nearest a name, at most ``window`` characters before or after it (of two as near, the first in the alphabet); null where none does."""
    word, gap = rf"\b\Q{name}\E\b", rf"(.{{0,{window}}}?)"
    after, before = rf"(?is){word}(?={gap}\b({AGE})\b)", rf"(?is)\b({AGE})\b(?={gap}{word})"
    spots = [F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(g)).alias("gap"), F.regexp_extract_all(text, F.lit(p), F.lit(a)).alias("age")) for p, g, a in ((after, 1, 2), (before, 2, 1))]
    spots = F.transform(F.concat(*spots), lambda s: F.struct(F.length(s["gap"]).alias("gap"), s["age"].alias("age")))
    return F.array_min(spots)["age"]


def depth_before(text: Column, name: str, window: int = 30) -> Column:
    """The last depth within ``window`` characters before a name's first mention."""
    near = F.regexp_extract(text, rf"(?is)(.{{0,{window}}})\b\Q{name}\E\b", 1)
    return F.replace(F.try_element_at(F.regexp_extract_all(near, F.lit(r"(\d[\d,]{2,6}(?:\.\d+)?)\s*-?\s*m\b")), F.lit(-1)), F.lit(","), F.lit("")).try_cast("double")


def suggestions(passages: DataFrame, names: list[str], most: int = 25) -> DataFrame:
    """What each basin's passages (basin, ref, text) say: for every rock class and listed name its first passage, with up to three depths, at most ``most`` a basin (a list to choose from)."""
    from borelog.operators import sequences

    kinds = [("lithology", k, _word(F.col("text"), w)) for k, w in CLASSES.items()] + [("formation", n, F.col("text").rlike(rf"(?iu)\b\Q{n}\E\b")) for n in names]
    found = F.filter(F.array(*[F.when(hit, F.struct(F.lit(t).alias("type"), F.lit(v).alias("value"))) for t, v, hit in kinds]), lambda x: x.isNotNull())
    rows = passages.select("basin", "ref", "text", F.explode(found).alias("f"))
    first = rows.groupBy("basin", "f.type", "f.value").agg(F.min(F.struct("ref", "text")).alias("m")).select("basin", "type", "value", "m.ref", "m.text")
    hints = F.slice(F.regexp_extract_all("text", F.lit(DEPTH_HINT)), 1, 3)
    return sequences.top_n(first.withColumn("depths", hints), most, ["basin"], [F.col("ref"), F.col("type"), F.col("value")]).drop("rank")


def analog_posterior(weights: DataFrame, recorded: DataFrame, base: DataFrame, by: list[str], strength: float = 20.0, least: float = 3.0) -> DataFrame:
    """For each group ``by`` and problem of ``base`` (hazard, base): the Beta posterior from the analog wells of ``weights`` (by, well_id, weight).

    A well counts with its weight, as a hit where ``recorded`` (well_id, hazard, each once) has it; weights are summed as
    decimals, so the order of rows does not matter. ``base`` is a closed list of problems."""
    w = weights.where("weight > 0").select(*by, "well_id", F.col("weight").cast("decimal(18,10)").alias("w"))
    total = w.groupBy(*by).agg(F.count("*").alias("n_wells"), F.sum("w").cast("double").alias("sw"), F.sum(F.col("w") * F.col("w")).cast("double").alias("sw2"))
    hits = w.join(recorded, "well_id").groupBy(*by, "hazard").agg(F.count("*").alias("n_with"), F.sum("w").cast("double").alias("swy"))
    rows = total.crossJoin(F.broadcast(base)).join(hits, [*by, "hazard"], "left").withColumns({"n_with": F.coalesce("n_with", F.lit(0)), "swy": F.coalesce("swy", F.lit(0.0))})
    mean = (strength * F.col("base") + F.col("swy")) / (strength + F.col("sw"))
    n_eff = F.col("sw") * F.col("sw") / F.col("sw2")
    return rows.select(*by, "hazard", "n_wells", "n_with", "base", mean.alias("mean"), n_eff.alias("n_eff"), F.when(F.round(n_eff, 1) >= least, "ok").otherwise("insufficient_evidence").alias("status"))


def column(sentences: DataFrame, names: list[str], most: int = 3) -> DataFrame:
    """A column of layers out of text (document_id, ref, text): for each of ``names`` the sentences and documents that name it, its
    rock by vote, the age most often nearest to it (of two as often, the first in the alphabet) and its first depths. A name
    that no sentence holds has counts of 0. The names are a list that people keep; none of their sentences are gathered."""
    from borelog.operators import sequences

    one = [F.when(F.col("text").rlike(rf"(?iu)\b\Q{n}\E\b"), F.struct(F.lit(n).alias("name"), nearest_age(F.col("text"), n).alias("age"), depth_before(F.col("text"), n).alias("depth"))) for n in names]
    spots = sentences.select("document_id", "ref", F.explode(F.array_compact(F.array(*one))).alias("s")).select("document_id", "ref", "s.*")
    counts = spots.groupBy("name").agg(F.count("*").alias("n_sentences"), F.countDistinct("document_id").alias("n_documents"))
    ages = spots.where("age is not null").groupBy("name", "age").agg(F.count("*").alias("n"))
    age = ages.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "age"))["age"].alias("age"))
    first = sequences.top_n(spots.where("depth is not null"), most, ["name"], [F.col("ref"), F.col("depth")])
    depths = first.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "depth"))), lambda x: x["depth"]).alias("depths"))
    every = sentences.sparkSession.createDataFrame([(n,) for n in names], "name string")
    rock = votes(sentences, names).select("name", "rock")
    out = every.join(counts, "name", "left").join(rock, "name", "left").join(age, "name", "left").join(depths, "name", "left")
    return out.select("name", F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "rock", "age", F.coalesce("depths", F.array().cast("array<double>")).alias("depths"))
