"""Linking the spellings of one person or institution.

A spelling is folded (case, diacritics, marks, titles) and read as surname, given name and middle initials, or as an
institution's name, type and topic. Misspellings are found by exact radius joins under an edit metric
(:mod:`paperloom.llm.metric`), one over given names and one over surnames; all further steps are joins on compact keys.
Given names and surnames are told from misspellings by their use over the whole table, not by a list.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperloom.llm.metric import radius_join
from paperloom.session import cut

#: Common English and Spanish, Russian short forms and the names they stand for.
SHORT = {
    "abby": "abigail", "alex": "alexander", "sasha": "alexander", "andy": "andrew", "drew": "andrew", "tony": "anthony",
    "ben": "benjamin", "charlie": "charles", "chuck": "charles", "chris": "christopher", "kit": "christopher",
    "dan": "daniel", "danny": "daniel", "dani": "daniela", "deb": "deborah", "debbie": "deborah", "dima": "dmitri", "mitya": "dmitri",
    "ed": "edward", "eddie": "edward", "ted": "edward theodore", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth",
    "paco": "francisco", "pancho": "francisco", "fred": "frederick", "freddie": "frederick", "gabi": "gabriella", "gaby": "gabriella",
    "greg": "gregory", "jim": "james", "jimmy": "james", "jamie": "james", "jen": "jennifer", "jenny": "jennifer",
    "joe": "joseph", "joey": "joseph", "josie": "josephine", "jo": "josephine", "kate": "katherine", "katie": "katherine", "kathy": "katherine", "kat": "katherine",
    "larry": "lawrence", "laurie": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "maggie": "margaret", "peggy": "margaret", "meg": "margaret",
    "matt": "matthew", "mike": "michael", "mick": "michael", "mickey": "michael", "nick": "nicholas", "pat": "patricia", "trish": "patricia", "patty": "patricia", "tricia": "patricia",
    "becky": "rebecca", "becca": "rebecca", "rich": "richard", "rick": "richard", "dick": "richard", "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert",
    "sam": "samuel", "steve": "stephen", "sue": "susanna", "susie": "susanna", "theo": "theodore", "tom": "thomas", "tommy": "thomas", "tim": "timothy", "timmy": "timothy",
    "vicky": "victoria", "tori": "victoria", "volodya": "vladimir", "vova": "vladimir", "vlad": "vladimir", "bill": "william", "will": "william", "billy": "william", "liam": "william",
    "gosia": "malgorzata", "kasia": "katarzyna", "hans": "johannes", "pepe": "jose", "lupe": "guadalupe", "nacho": "ignacio", "misha": "mikhail", "kolya": "nikolai", "katya": "ekaterina",
    "johnny": "john", "jack": "john", "harry": "henry", "hank": "henry", "ron": "ronald", "don": "donald", "ken": "kenneth", "dave": "david", "jeff": "jeffrey", "jerry": "gerald",
    "sally": "sarah", "molly": "mary", "polly": "mary", "nancy": "ann", "annie": "ann", "ellie": "eleanor", "nell": "eleanor", "cathy": "catherine", "barb": "barbara", "bea": "beatriz", "wendy": "gwendolyn",
}
#: Words that make a spelling an institution, by their first letters, and their abbreviations.
TYPES = {"laboratory": "lab", "lab": "lab", "labs": "lab", "institute": "inst", "inst": "inst", "centre": "ctr", "center": "ctr", "ctr": "ctr", "cent": "ctr", "consortium": "cons", "cons": "cons", "department": "dept", "dept": "dept", "university": "univ", "univ": "univ", "group": "grp", "grp": "grp", "school": "sch", "sch": "sch", "faculty": "fac", "fac": "fac", "academy": "acad", "acad": "acad", "college": "coll", "coll": "coll"}
SMALL = {"for", "of", "f", "the", "and", "in", "on", "de", "du", "des", "fur"}
TITLES = re.compile(r"^(?:(?:dr|prof|mr|mrs|ms|sir|dame)\b\.?\s*)+", re.IGNORECASE)
NOBODY = re.compile(r"^(?:et\.?\s*al\.?|others|and others|anonymous|unknown|n/?a|none|various|.{0,1})$", re.IGNORECASE)
MARKS = re.compile(r"[*†‡§¶#0-9⁰-⁹¹²³]+")
#: Letters kept of each word of an institution's topic; abbreviations keep at least as many.
STEM = 4

#: A given name is a misspelling of one used with so many times as many surnames.
RARER = 4
READ = "name string, kind string, first string, last string, middle string, fixed boolean"


def fold(name: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower().replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("đ", "d")


def read(name: str) -> tuple[str, str, str, str, bool] | None:
    """Kind, given name, surname, middle initials, and whether the order of the two is certain.

    Institutions give their name as surname and ``#type topic`` as given name. Null for what is no name.
    """
    raw = " ".join(MARKS.sub(" ", unicodedata.normalize("NFC", name)).replace("’", "'").split()).strip(" ,;")
    if NOBODY.match(raw):
        return None
    raw = TITLES.sub("", raw)
    words = re.findall(r"[^\W_]+(?:['-][^\W_]+)*", fold(raw))
    if any(w in TYPES for w in words) and len(words) >= 3:
        return _institution(raw)
    if "," in raw:
        last, _, first = (x.strip() for x in raw.partition(","))
        given, middle = _given(first.split())
        return ("person", given, fold(last).replace(" ", "-"), middle, True) if given and last else None
    parts = raw.split()
    if len(parts) == 1:
        return ("person", "", fold(parts[0]), "", True)
    if len(parts) == 2 and re.fullmatch(r"[A-Z]{1,3}", parts[1]) and not parts[0].isupper():  # Surname FM
        return ("person", fold(parts[1][0]), fold(parts[0]), fold(parts[1][1:]), True)
    tail = [p for p in parts[1:] if _initial(p)]
    if len(parts) >= 2 and tail and len(tail) == len(parts) - 1 and not _initial(parts[0]):  # Surname F. M.
        given, middle = _given(tail)
        return ("person", given, fold(parts[0]), middle, True)
    given, middle = _given(parts[:-1])
    certain = any(_initial(p) for p in parts[:-1])
    return ("person", given, fold(parts[-1]), middle, certain) if given else None


def _initial(p: str) -> bool:
    return re.fullmatch(r"[^\W\d_]\.?(?:-[^\W\d_]\.?)?|(?:[^\W\d_]\.){2,3}", p) is not None


def _given(parts: list[str]) -> tuple[str, str]:
    """Given name (hyphenated if double) and middle initials."""
    if not parts:
        return "", ""
    folded = [fold(p) for p in parts]
    if _initial(parts[0]):
        letters = [x for p in folded for x in ([p.replace(".", "")] if "-" in p else [c for c in p if c.isalpha()])]
        return letters[0], "".join(letters[1:])
    full = [p.strip(".") for p, raw in zip(folded, parts, strict=True) if not _initial(raw)]
    middle = "".join(c for p, raw in zip(folded, parts, strict=True) if _initial(raw) for c in p if c.isalpha())
    return "-".join(full), middle


def _institution(raw: str) -> tuple[str, str, str, str, bool] | None:
    text = fold(raw)
    if "," in text:  # Type for Topic, Name
        head, _, tail = text.partition(",")
        if any(w in TYPES for w in re.findall(r"[a-z]+", head)):
            text = f"{tail.strip()} {head.strip()}"
    words = [w for w in re.findall(r"[^\W\d_]+", text) if w not in SMALL]
    at = next((i for i, w in enumerate(words) if w in TYPES), None)
    if at is None:
        return None
    if at == 0:
        return ("institution", "#" + TYPES[words[0]] + "".join(" " + w[:STEM] for w in words[1:]), "", "", True)
    return ("institution", "#" + TYPES[words[at]] + "".join(" " + w[:STEM] for w in words[at + 1 :]), "-".join(words[:at]), "", True)


def read_names(names: DataFrame) -> DataFrame:
    """The readings of distinct ``names(name)``; what is no name is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n, *r) for n in batch["name"] if n and (r := read(n))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])

    return names.mapInPandas(run, READ)


class NameLinks:
    """Entities behind the distinct spellings of ``names(name, n)``, ``n`` being the rows of a spelling.

    ``entities``: ``name, entity``, one row per spelling that is a name; null, blank and nobody's spellings are left out.
    Spellings are linked when their surnames agree up to one slip and their given names agree up to one slip, a short
    form or an initial; an initial or an ambiguous short form is linked only where one full name fits. Two surnames one
    edit apart stay apart when the first letter differs, or when both have several given names, built of usual letter
    groups, and share fewer than half of the rarer one's; two given names stay apart when both are usual. Differing middle initials stay apart.
    ``short`` maps short forms to the names they stand for, several with blanks between.
    """

    def __init__(self, names: DataFrame, short: Mapping[str, str] = SHORT):
        self.short = dict(short)
        counted = names.where(F.col("name").isNotNull()).groupBy("name").agg(F.sum("n").alias("n"))
        read_ = read_names(counted.select("name")).join(counted, "name")
        oriented = self._orient(read_)
        self.forms = cut(oriented)
        resolved = cut(self._given_names(self.forms))
        self.entities = self._entities(resolved)

    def _orient(self, rows: DataFrame) -> DataFrame:
        """Swap `Surname Given` written without a comma, where the last word is the one used as a given name."""
        people = rows.where((F.col("kind") == "person") & (F.length("first") > 1))
        known = people.groupBy(F.col("first").alias("t")).agg(F.countDistinct("last").alias("g"))
        last = people.groupBy(F.col("last").alias("t")).agg(F.countDistinct("first").alias("s"))
        short = F.create_map(*[F.lit(x) for k in self.short for x in (k, True)])
        use = known.join(last, "t", "full").select("t", (F.coalesce("g", F.lit(0)) + F.when(F.coalesce(short[F.col("t")], F.lit(False)), 50).otherwise(0)).alias("g"), F.coalesce("s", F.lit(0)).alias("s"))
        # A double name is judged by its first part, since few people share the whole.
        rows = rows.withColumns({"_f": F.substring_index("first", "-", 1), "_l": F.substring_index("last", "-", 1)})
        joined = rows.join(use.select(F.col("t").alias("_f"), F.col("g").alias("fg")), "_f", "left").join(use.select(F.col("t").alias("_l"), F.col("g").alias("lg"), F.col("s").alias("ls")), "_l", "left")
        # "A-B" may be two words of which the last one or two are given names: "Surname G1 G2" reads as first "surname-g1".
        swap = ~F.col("fixed") & (F.col("kind") == "person") & (F.coalesce("lg", F.lit(0)) > 2 * F.coalesce("fg", F.lit(0))) & (F.coalesce("lg", F.lit(0)) > F.coalesce("ls", F.lit(0)))
        parts = F.split("first", "-")
        given = F.when(swap, F.concat_ws("-", F.slice(parts, 2, 9), F.col("last"))).otherwise(F.col("first"))
        surname = F.when(swap, parts[0]).otherwise(F.col("last"))
        return joined.select("name", "n", "kind", given.alias("g"), surname.alias("s"), F.col("middle").alias("m"))

    def _given_names(self, forms: DataFrame) -> DataFrame:
        """The formal given name of every form: itself, what it is short for, or what it misspells."""
        full = forms.where(~_is_initial(F.col("g")))
        use = full.where(F.col("kind") == "person").groupBy("g").agg(F.countDistinct("s").alias("u"))
        near = radius_join(use.select(F.col("g").alias("key")), 1)
        both = near.select(F.col("a").alias("g"), F.col("b").alias("c")).unionByName(near.select(F.col("b").alias("g"), F.col("a").alias("c")))
        slips = both.join(use, "g").join(use.select(F.col("g").alias("c"), F.col("u").alias("cu")), "c").where((F.col("cu") >= F.col("u") * RARER) | F.col("g").contains("-")).select("g", "c", F.lit("slip").alias("how"), "cu")
        shorts = forms.sparkSession.createDataFrame([(k, c) for k, v in self.short.items() for c in v.split()], "g string, c string")  # a fixed list
        sized = shorts.groupBy("g").agg(F.count(F.lit(1)).alias("ways"))
        options = slips.withColumn("ways", F.lit(99)).unionByName(shorts.join(sized, "g").select("g", "c", F.lit("short").alias("how"), F.lit(0).cast("bigint").alias("cu"), F.col("ways").cast("int")))
        # Options under which the person exists come first, then the one meaning of a short form, then the most usual name.
        people = full.where(F.col("kind") == "person").groupBy("s", F.col("g").alias("c")).agg(F.sum("n").alias("held"))
        wanted = full.where(F.col("kind") == "person").select("s", "g").distinct().join(options, "g").join(people, ["s", "c"], "left")
        held = F.col("held").isNotNull()
        picked = (
            wanted.groupBy("s", "g")
            .agg(
                F.count_if(held & (F.col("how") == "short")).alias("n_short"),
                F.max(F.when(held & (F.col("how") == "short"), F.col("c"))).alias("short"),
                F.max(F.when(held & (F.col("how") == "slip"), F.struct("held", "c"))).alias("slip"),
                F.max(F.when((F.col("how") == "short") & (F.col("ways") == 1), F.col("c"))).alias("only"),
                F.max(F.when(F.col("how") == "slip", F.struct("cu", "c"))).alias("likely"),
            )
            .select("s", "g", F.coalesce(F.when(F.col("n_short") == 1, F.col("short")), F.col("slip.c"), F.col("only"), F.col("likely.c")).alias("f"))
        )
        out = forms.join(picked, ["s", "g"], "left")
        return out.select("name", "n", "kind", "s", "g", "m", F.coalesce("f", "g").alias("f"))

    @staticmethod
    def _entities(rows: DataFrame) -> DataFrame:
        full = rows.where(~_is_initial(F.col("f")))
        brief = rows.where(_is_initial(F.col("f")))
        # People: surname and formal given name, apart by middle initial where several are in use.
        people = full.groupBy("kind", "s", "f").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set(F.nullif("m", F.lit("")))).alias("ms"))
        use = people.groupBy("s").agg(F.count(F.lit(1)).alias("givens"))
        grams = use.select("s", F.explode(F.expr("transform(sequence(1, length(s)), i -> substr(concat('^', s, '$'), i, 3))")).alias("t"))
        seen = grams.distinct().groupBy("t").agg(F.count(F.lit(1)).alias("c"))
        shape = grams.join(seen, "t").groupBy("s").agg(F.min("c").alias("usual"))
        use = cut(use.join(shape, "s", "left").select("s", "givens", F.coalesce("usual", F.lit(0)).alias("usual")))
        near = radius_join(use.select(F.col("s").alias("key")), 1)
        pairs = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        swapped = (F.substring("a", 1, 1) == F.substring("b", 2, 1)) & (F.substring("a", 2, 1) == F.substring("b", 1, 1))
        ua, ub = (use.select(F.col("s").alias(x), F.col("givens").alias(f"{x}g"), F.col("usual").alias(f"{x}u")) for x in "ab")
        close = pairs.where((F.substring("a", 1, 1) == F.substring("b", 1, 1)) | swapped).join(ua, "a").join(ub, "b")
        # A slip is made by people who also use the right spelling; a surname of its own has people of its own.
        of_a, of_b = (people.select(F.col("s").alias(x), "kind", "f") for x in "ab")
        common = close.select("a", "b").join(of_a, "a").join(of_b, ["b", "kind", "f"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
        fewer = F.least("ag", "bg")
        apart = (fewer > 1) & (F.col("common") * 2 < fewer) & (F.least("au", "bu") * 4 >= F.greatest("au", "bu"))
        linked = cut(close.join(common, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0))).where(~apart))
        # Each person points to the best other spelling of the surname, if that is better established than its own.
        p = people.select("kind", "f", F.col("s").alias("a"), F.col("n").alias("an"), F.col("ms").alias("am"))
        q = people.select("kind", "f", F.col("s").alias("b"), F.col("n").alias("bn"), F.col("ms").alias("bm"))
        agree = (F.size("am") == 0) | (F.size("bm") == 0) | F.arrays_overlap("am", "bm")
        better = F.struct("bg", "bu", "bn", "b") > F.struct("ag", "au", "an", "a")
        to = linked.join(p, "a").join(q, ["kind", "f", "b"]).where(agree & better).groupBy("kind", "f", "a").agg(F.max(F.struct("bg", "bu", "bn", "b")).alias("t")).select("kind", "f", F.col("a").alias("s"), F.col("t.b").alias("to"))
        root = _roots(people.select("kind", "f", "s").join(to, ["kind", "f", "s"], "left").select("kind", "f", "s", F.coalesce("to", "s").alias("to")))
        homed = full.join(root, ["kind", "f", "s"]).select("name", "kind", "f", "m", F.col("to").alias("s"))
        middles = homed.groupBy("kind", "s", "f").agg(F.array_compact(F.array_sort(F.collect_set(F.nullif("m", F.lit(""))))).alias("ms"))
        part = F.when(F.size("ms") > 1, F.col("m")).otherwise(F.lit(""))
        known = homed.join(middles, ["kind", "s", "f"]).select("name", "kind", "s", "f", F.concat_ws("|", F.col("kind"), "s", "f", part).alias("entity"))
        # Initials: the one full name of that surname, or of a surname one slip away, that begins so.
        own = root.select("kind", F.col("s").alias("at"), "f", F.col("to").alias("s")).join(middles, ["kind", "s", "f"])
        far = linked.select(F.col("a").alias("at"), F.col("b").alias("s0")).join(root.select("kind", F.col("s").alias("s0"), "f", F.col("to").alias("s")), "s0").join(middles, ["kind", "s", "f"])
        fits = own.withColumn("near", F.lit(0)).unionByName(far.drop("s0").withColumn("near", F.lit(1)), allowMissingColumns=True)
        initials = F.array_join(F.transform(F.split("f", "-"), lambda x: F.substring(x, 1, 1)), "-")
        lead = F.explode(F.array_distinct(F.array(initials, F.substring("f", 1, 1))))
        table = fits.withColumn("i", lead).select("at", "i", "s", "f", "ms", "near").distinct()
        asked = brief.select(F.col("s").alias("at"), F.col("f").alias("i"), "m").distinct()
        m = F.col("m")
        ok = (m == "") | (F.size("ms") == 0) | F.array_contains("ms", m)
        score = (F.col("near") * 2 + F.when((m != "") & ~F.coalesce(F.array_contains("ms", m), F.lit(False)), 1).otherwise(0)).alias("score")
        chosen = (
            asked.join(table, ["at", "i"])
            .where(ok)
            .select("at", "i", "m", "s", "f", "ms", score)
            .groupBy("at", "i", "m", "score")
            .agg(F.countDistinct("s", "f").alias("k"), F.min(F.struct("s", "f", "ms")).alias("t"))
            .groupBy("at", "i", "m")
            .agg(F.min(F.struct("score", "k", "t")).alias("best"))
            .where(F.col("best.k") == 1)
            .select("at", "i", "m", F.col("best.t.s").alias("s"), F.col("best.t.f").alias("f"), F.col("best.t.ms").alias("ms"))
        )
        lone = F.concat_ws("|", F.lit("person"), F.col("at"), F.col("i"), F.lit("?"))
        short = brief.select("name", F.col("s").alias("at"), F.col("f").alias("i"), "m").join(chosen, ["at", "i", "m"], "left")
        short = short.select("name", F.when(F.col("f").isNull(), lone).otherwise(F.concat_ws("|", F.lit("person"), "s", "f", F.when(F.size("ms") > 1, F.col("m")).otherwise(F.lit("")))).alias("entity"))
        return known.select("name", "entity").unionByName(short)


def _is_initial(c):
    return (F.length(c) <= 1) | c.rlike("^[^#]-[^#]$")


def _roots(to: DataFrame) -> DataFrame:
    """Follow pointers to their end by doubling; a pointer always leads to a better established spelling, so they end."""
    while True:
        to = cut(to)
        step = to.join(to.select("kind", "f", F.col("s").alias("to"), F.col("to").alias("next")), ["kind", "f", "to"])
        moved = step.where(F.col("next") != F.col("to")).limit(1).count()
        if not moved:
            return to
        to = step.select("kind", "f", "s", F.col("next").alias("to"))


def name_pairs(entities: DataFrame) -> DataFrame:
    """Pairs of different spellings of one entity: ``name_a < name_b``."""
    a = entities.select("entity", F.col("name").alias("name_a"))
    b = entities.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b").distinct()


def clusters(entities: DataFrame) -> DataFrame:
    """``name, entity_id, n_spellings``; the id is the smallest spelling of the entity."""
    w = W.partitionBy("entity")
    return entities.select("name", F.min("name").over(w).alias("entity_id"), F.count(F.lit(1)).over(w).alias("n_spellings"))
