"""Sentences for assertions of every type, as one column expression over the row's arguments.

``args`` is the array of an assertion's arguments (structs as in the agents table, in order). An argument is named with its mutations, place,
partners, modifications and activity. ``sentences`` works them out for a corpus, without a shuffle where arguments are on the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import picked
from ..schema import ADDING, REMOVING, Corpus

# Full names of residues.
RESIDUES = {
    "A": "alanine", "R": "arginine", "N": "asparagine", "D": "aspartic acid", "C": "cysteine", "E": "glutamic acid", "Q": "glutamine", "G": "glycine", "H": "histidine", "I": "isoleucine", "L": "leucine",
    "K": "lysine", "M": "methionine", "F": "phenylalanine", "P": "proline", "S": "serine", "T": "threonine", "W": "tryptophan", "Y": "tyrosine", "V": "valine",
}
# What stands before "active" (and, where it differs, before "inactive") and after "is" in an active form.
ACTIVE_PREFIX = {"catalytic": "catalytically ", "gap": "GAP-", "gef": "GEF-", "gtpbound": "GTP-bound ", "kinase": "kinase-", "phosphatase": "phosphatase-", "transcription": "transcriptionally "}
INACTIVE_PREFIX = ACTIVE_PREFIX | {"gtpbound": "GDP-bound "}
FORM_PREFIX = {"kinase": "kinase-", "phosphatase": "phosphatase-", "catalytic": "catalytically ", "transcription": "transcriptionally ", "gtpbound": "GTP-bound "}


def join_list(words: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(words)
    return F.when(n > 2, F.concat(F.array_join(F.slice(words, 1, n - 1), ", "), F.lit(", and "), F.element_at(words, -1))).when(n == 2, F.concat_ws(" and ", words[0], words[1])).when(n == 1, words[0]).otherwise("")


def verb_of(noun: Column) -> Column:
    """phosphorylation to phosphorylates."""
    return F.regexp_replace(noun, "ation$", "ates")


def state_of(noun: Column) -> Column:
    """phosphorylation to phosphorylated."""
    return F.when(noun == "modification", "modified").otherwise(F.regexp_replace(noun, "ation$", "ated"))


def _or(c: Column, other: str = "") -> Column:
    return F.coalesce(c, F.lit(other))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def agent_text(a: Column) -> Column:
    """An argument with its states."""
    none = lambda c: F.coalesce(F.size(c), F.lit(-1)) <= 0
    muts = F.transform(a["mutations"], lambda m: F.concat(_or(m["residue_from"]), _or(m["position"]), _or(m["residue_to"])))
    named = let(muts, lambda m: F.when(none(a["mutations"]), a["name"]).when((F.size(m) == 1) & (m[0] == ""), F.concat(F.lit("mutated "), a["name"])).otherwise(F.concat(a["name"], F.lit("-"), F.array_join(m, "/"))))
    names = lambda b: F.transform(F.filter(a["bound"], lambda x: x["is_bound"] == b), lambda x: x["name"])
    held, free = names(F.lit(True)), names(F.lit(False))
    partners = F.when(none(a["bound"]), "").otherwise(F.concat(F.when(none(held), "").otherwise(F.concat(F.lit(" bound to "), join_list(held))), F.when(none(held) | none(free), "").otherwise(" and"), F.when(none(free), "").otherwise(F.concat(F.lit(" not bound to "), join_list(free)))))
    plain = F.concat(named, _or(F.concat(F.lit(" in the "), a["location"])), partners)
    first = a["mods"][0]
    state = state_of(first["mod_type"])
    single = F.when(first["residue"].isNotNull(), F.concat(picked(RESIDUES, first["residue"]), F.lit("-"), state)).when(~first["is_modified"], F.concat(F.lit("un"), state)).otherwise(state)
    site = lambda m: F.when(m["position"].isNull(), F.coalesce(picked(RESIDUES, m["residue"]), F.lit("an unknown residue"))).when(m["residue"].isNull(), F.concat(F.lit("amino acid "), m["position"])).otherwise(F.concat(m["residue"], m["position"]))
    alone = (F.size(a["mods"]) == 1) & first["position"].isNull()
    before = F.when(none(a["mods"]) | ~alone, "").otherwise(F.concat(single, F.lit(" ")))
    after = F.when(none(a["mods"]) | alone, "").otherwise(F.concat(F.when(none(a["bound"]), "").otherwise(" and"), F.lit(" "), state, F.lit(" on "), let(F.transform(a["mods"], site), join_list)))
    act = a["activity"]
    flag = F.when(act["is_active"], F.concat(_or(picked(ACTIVE_PREFIX, act["activity_type"])), F.lit("active "))).when(~act["is_active"], F.concat(_or(picked(INACTIVE_PREFIX, act["activity_type"])), F.lit("inactive "))).otherwise("")
    return F.concat(flag, before, plain, after)


def finished(text: Column) -> Column:
    """With a large first letter and a full stop."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20), F.lit("."))


def texts(args: Column) -> Column:
    """(idx, role, text) of the arguments that have a name, in order."""
    by_place = lambda x, y: F.when(x["idx"] < y["idx"], -1).when(x["idx"] > y["idx"], 1).otherwise(0)
    return F.transform(F.array_sort(F.filter(args, lambda a: a["name"].isNotNull()), by_place), lambda a: F.struct(a["idx"].alias("idx"), a["role"].alias("role"), agent_text(a).alias("text")))


def sentence(first: Column, second: Column, told: Column, stmt_type: Column, residue: Column, position: Column, activity: Column, is_active: Column, from_location: Column, to_location: Column, direct: Column | None = None, polarity: Column | None = None) -> Column:
    """One sentence of the texts of the arguments: at place 0, at place 1, and all of them as of ``texts``; null where one that the type needs is missing.

    ``direct`` false tells of a modification that it is led to; ``polarity``: array of the signs of an influence's two sides."""
    named = F.transform(told, lambda x: x["text"])
    role = lambda r: F.transform(F.filter(told, lambda a: a["role"] == r), lambda a: a["text"])
    noun = F.lower(stmt_type)
    where = F.when(residue.isNotNull(), F.when(position.isNull(), F.concat(F.lit(" on "), picked(RESIDUES, residue))).otherwise(F.concat(F.lit(" on "), residue, position))).when(position.isNotNull(), F.concat(F.lit(" at position "), position)).otherwise("")
    mods = stmt_type.isin(*ADDING, *REMOVING, "Modification")
    direct_verb = F.concat_ws(" ", first, F.when(stmt_type == "Modification", "modifies").otherwise(verb_of(noun)), second)
    done = direct_verb if direct is None else F.when(F.coalesce(direct, F.lit(True)), direct_verb).otherwise(F.concat(first, F.lit(" leads to the "), noun, F.lit(" of "), second))
    modified = F.concat(F.when(first.isNull(), F.concat(second, F.lit(" is "), state_of(noun))).otherwise(done), where)
    two = lambda verb: F.concat(first, F.lit(verb), second)
    many = lambda verb: F.concat(named[0], F.lit(verb), join_list(F.slice(named, 2, F.greatest(F.size(named) - 1, F.lit(0)))))
    amount = lambda verb, alone: F.when(first.isNull(), F.concat(second, F.lit(alone))).otherwise(two(verb))
    made = F.concat(join_list(role("obj_from")), F.lit(" into "), join_list(role("obj_to")))
    conversion = F.when(first.isNull(), F.concat(join_list(role("obj_from")), F.lit(" is converted into "), join_list(role("obj_to")))).otherwise(F.concat(first, F.lit(" catalyzes the conversion of "), made))
    side = lambda text, i: text if polarity is None else F.concat(F.coalesce(F.when(polarity[i] == -1, "a decrease in ").when(polarity[i] == 1, "an increase in "), F.lit("")), text)
    moved = F.concat(first, F.lit(" translocates"), _or(F.concat(F.lit(" from the "), from_location)), _or(F.concat(F.lit(" to the "), to_location)))
    text = (
        F.when(mods, modified)
        .when(stmt_type.isin("Activation", "GtpActivation"), two(" activates "))
        .when(stmt_type == "Inhibition", two(" inhibits "))
        .when(stmt_type == "IncreaseAmount", amount(" increases the amount of ", " is produced"))
        .when(stmt_type == "DecreaseAmount", amount(" decreases the amount of ", " is degraded"))
        .when(stmt_type == "Complex", many(" binds "))
        .when(stmt_type == "Association", many(" is associated with "))
        .when(stmt_type == "Gef", two(" is a GEF for "))
        .when(stmt_type == "Gap", two(" is a GAP for "))
        .when(stmt_type.isin("Autophosphorylation", "SelfModification"), F.concat(first, F.lit(" phosphorylates itself"), where))
        .when(stmt_type == "Transphosphorylation", F.concat(first, F.lit(" phosphorylates its bound partner"), where))
        .when(stmt_type == "ActiveForm", F.concat(first, F.lit(" is "), _or(picked(FORM_PREFIX, activity)), F.when(is_active, "active").otherwise("inactive")))
        .when(stmt_type == "HasActivity", F.concat(first, F.when(F.coalesce(is_active, F.lit(True)), " has ").otherwise(" does not have "), activity, F.lit(" activity")))
        .when(stmt_type.isin("Translocation", "Migration"), moved)
        .when(stmt_type == "Conversion", conversion)
        .when(stmt_type == "Influence", F.concat(side(first, 0), F.lit(" causes "), side(second, 1)))
        .otherwise(F.concat_ws(" affects ", first, second))
    )
    return finished(text)


def sentences(c: Corpus) -> DataFrame:
    """(stmt_id, sentence). An assertion is indirect only if its evidence says so and none says otherwise."""
    if "args" in c.statements.columns:
        rows = c.statements
    else:
        cols = [x for x in c.agents.columns if x != "stmt_id"]
        rows = c.statements.join(c.agents.groupBy("stmt_id").agg(F.collect_list(F.struct(*cols)).alias("args")), "stmt_id", "left")
    said = c.evidence.groupBy("stmt_id").agg(F.bool_or("direct").alias("__direct"))
    rows = rows.join(said, "stmt_id", "left").withColumn("__t", F.coalesce(texts(F.col("args")), F.array().cast("array<struct<idx:int,role:string,text:string>>")))
    at = lambda i: F.try_element_at(F.filter("__t", lambda a: a["idx"] == i), F.lit(1))["text"]
    rows = rows.withColumns({"__first": at(0), "__second": at(1)})
    return rows.select("stmt_id", sentence(F.col("__first"), F.col("__second"), F.col("__t"), *(F.col(x) for x in ("stmt_type", "residue", "position", "activity", "is_active", "from_location", "to_location")), F.col("__direct")).alias("sentence"))


def model(c: Corpus) -> DataFrame:
    """(value): all sentences, each on a line, in the order of their ids; the text is one row a sentence, joined by whoever writes it."""
    return sentences(c).where("sentence is not null").orderBy("stmt_id").select(F.col("sentence").alias("value"))
