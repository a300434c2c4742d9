"""Rule models as tables: monomers with sites, rules with patterns and rates, starting amounts, and their text in rule languages.

A policy says how an assertion of a type becomes rules: ``one_step``, ``two_step``, ``multi_way``, ``interactions_only``, ``atp_dependent``, or a rate law
(``michaelis_menten``, ``hill``) over the one-step rule. Everything but the look-up of what a synthesised or converted monomer looks like is an
expression over one assertion's row. A pattern is (monomer, sites): the value of a site is a state, ``.`` (free), ``_`` (bound to anything) or the number of a bond; a
side of a rule is an array of complexes, each an array of patterns.

Cases: assertions that lack an argument that the policy needs give no rule; rules of the same name are kept once (the least stmt_id's); types without a
template give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import picked
from ..runtime import checkpoint
from ..schema import ADDING, REMOVING, Corpus
from .english import let

PATTERN = "struct<monomer:string,sites:map<string,string>>"
SIDE = f"array<array<{PATTERN}>>"
RULE = f"struct<rule:string,lhs:{SIDE},rhs:{SIDE},made:array<string>,param:string,value:double,rate:string>"
FREE, ANY = ".", "_"

# Names of modification sites without a residue, and their two states.
ABBREVIATIONS = {"phosphorylation": "phospho", "ubiquitination": "ub", "farnesylation": "farnesyl", "hydroxylation": "hydroxyl", "acetylation": "acetyl", "sumoylation": "sumo", "glycosylation": "glycosyl", "methylation": "methyl", "ribosylation": "ribosyl", "geranylgeranylation": "geranylgeranyl", "palmitoylation": "palmitoyl", "myristoylation": "myryl", "modification": "mod"}
PHOSPHO_STATES, OTHER_STATES = ("u", "p"), ("n", "y")
#: What a removing type takes away.
TAKES = {r: a.lower() for a, r in zip(ADDING, REMOVING, strict=True)} | {a: a.lower() for a in ADDING}

# Rates by kind.
RATES = {"bind": 1e-6, "unbind": 1e-1, "modify": 1e-6, "catalyse": 100.0, "km": 1e8, "autophos": 1e-2, "synth_alone": 2.0, "synth": 2e-4, "deg_alone": 2e-5, "deg": 2e-9, "translocate": 1.0, "interact": 1.0, "convert_alone": 2.0, "convert": 2e-4, "hill_kf": 4.0, "hill_ka": 1e4, "hill_n": 1.0, "influence_pos": 2e-9, "influence_neg": 2e-5}
INITIAL = 10_000.0


def plain_name(name: Column) -> Column:
    """A name that rule languages take: signs become underscores, and none begins with a digit."""
    out = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(out.rlike("^[0-9]"), F.concat(F.lit("p"), out)).otherwise(out)


def site_name(name: Column) -> Column:
    return F.lower(plain_name(name))


def _or(c: Column, other: str = "") -> Column:
    return F.coalesce(c, F.lit(other))


def mod_site(mod_type: Column, residue: Column, position: Column) -> Column:
    return F.concat(F.coalesce(residue, picked(ABBREVIATIONS, mod_type), mod_type), _or(position))


def mod_states(mod_type: Column) -> Column:
    pair = lambda p: F.array(*(F.lit(x) for x in p))
    return F.when(mod_type == "phosphorylation", pair(PHOSPHO_STATES)).otherwise(pair(OTHER_STATES))


def _entry(k: Column, v: Column) -> Column:
    return F.struct(k.alias("key"), v.alias("value"))


def _entries(c: Column, fn) -> Column:
    return F.coalesce(F.transform(c, fn), F.array().cast("array<struct<key:string,value:string>>"))


def mut_site(m: Column) -> Column:
    return F.concat(_or(m["residue_from"], "mut"), _or(m["position"]))


def conditions(a: Column) -> Column:
    """Sites that an argument's states ask for, as entries; the first of a name stands."""
    bound = _entries(a["bound"], lambda b: _entry(site_name(b["name"]), F.when(b["is_bound"], ANY).otherwise(FREE)))
    mods = _entries(a["mods"], lambda m: _entry(mod_site(m["mod_type"], m["residue"], m["position"]), F.when(m["is_modified"], mod_states(m["mod_type"])[1]).otherwise(mod_states(m["mod_type"])[0])))
    muts = _entries(a["mutations"], lambda m: _entry(mut_site(m), _or(m["residue_to"], "X")))
    place = F.when(a["location"].isNotNull(), F.array(_entry(F.lit("loc"), plain_name(a["location"]))))
    act = F.when(a["activity"]["activity_type"].isNotNull(), F.array(_entry(a["activity"]["activity_type"], F.when(a["activity"]["is_active"], "active").otherwise("inactive"))))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.concat(bound, mods, muts, F.coalesce(place, none), F.coalesce(act, none))


def pattern(a: Column, *extra: tuple[Column, Column], bare: bool = False) -> Column:
    """The monomer with its conditions (none where ``bare``) and further sites; a condition of the argument's own stands against one of these."""
    own = F.array().cast("array<struct<key:string,value:string>>") if bare else conditions(a)
    every = F.concat(own, F.array(*(_entry(k, v) for k, v in extra)).cast("array<struct<key:string,value:string>>")) if extra else own
    # of entries with a name the first
    first = lambda e: F.map_from_entries(F.filter(e, lambda x, i: F.array_position(F.transform(e, lambda y: y["key"]), x["key"]) == i + 1))
    return F.struct(plain_name(a["name"]).alias("monomer"), let(every, first).alias("sites")).cast(PATTERN)


def rule_text(a: Column) -> Column:
    """An argument's part of a rule's name: the name and a word for each state."""
    none = F.array().cast("array<string>")
    words = lambda c, fn: F.coalesce(F.transform(c, fn), none)
    mods = words(a["mods"], lambda m: F.concat(F.coalesce(picked(ABBREVIATIONS, m["mod_type"]), m["mod_type"]), _or(m["residue"]), _or(m["position"])))
    muts = words(a["mutations"], lambda m: F.concat(mut_site(m), _or(m["residue_to"], "X")))
    bound = words(a["bound"], lambda b: F.concat(F.when(b["is_bound"], "").otherwise("n"), plain_name(b["name"])))
    place = F.when(a["location"].isNotNull(), F.array(plain_name(a["location"])))
    act = F.when(a["activity"]["activity_type"].isNotNull(), F.array(F.concat(F.substring(a["activity"]["activity_type"], 1, 3), F.when(a["activity"]["is_active"], "").otherwise("_inact"))))
    return F.array_join(F.concat(F.array(plain_name(a["name"])), mods, muts, bound, F.coalesce(place, none), F.coalesce(act, none)), "_")


def _letters(*agents: Column) -> Column:
    return F.concat(*(F.lower(F.substring(a["name"], 1, 1)) for a in agents))


def side(*complexes) -> Column:
    """Complexes (a pattern, or a tuple of bound ones) of a rule's side."""
    return F.array(*(F.array(*(c if isinstance(c, tuple) else (c,))) for c in complexes)).cast(SIDE) if complexes else F.array().cast(SIDE)


def rule(name: Column, lhs: Column, rhs: Column, param: Column, value, rate: Column | None = None, made: Column | None = None) -> Column:
    made = made if made is not None else F.array().cast("array<string>")
    return F.struct(name.alias("rule"), lhs.alias("lhs"), rhs.alias("rhs"), made.alias("made"), param.alias("param"), (F.lit(RATES[value]) if isinstance(value, str) else value).alias("value"), (rate if rate is not None else param).alias("rate")).cast(RULE)


def many(*rules: Column) -> Column:
    return F.array(*rules).cast(f"array<{RULE}>")


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _modification(s: Column, o: Column, policy: str) -> Column:
    kind, mod = F.lower(F.col("stmt_type")), picked(TAKES, F.col("stmt_type"))
    site, states = mod_site(mod, F.col("residue"), F.col("position")), mod_states(mod)
    takes = F.col("stmt_type").isin(*REMOVING)
    off, on = F.when(takes, states[1]).otherwise(states[0]), F.when(takes, states[0]).otherwise(states[1])
    name = _text(rule_text(s), "_", kind, "_", rule_text(o), "_", site)
    ab = _letters(s, o)
    if policy == "interactions_only":
        active = F.when(F.col("stmt_type") == "Phosphorylation", "kinase").when(F.col("stmt_type") == "Dephosphorylation", "phosphatase").otherwise("catalytic")
        free = side(pattern(s, (active, F.lit(FREE)), bare=True), pattern(o, (site, F.lit(FREE)), bare=True))
        return many(rule(name, free, side((pattern(s, (active, F.lit("1")), bare=True), pattern(o, (site, F.lit("1")), bare=True))), F.lit("kf_bind"), "interact"))
    if policy in ("two_step", "atp_dependent"):
        sb, eb = site_name(o["name"]), site_name(s["name"])
        atp = [(F.lit("ATP"), F.lit("2"))] if policy == "atp_dependent" else []
        enz = lambda v, *more: pattern(s, (sb, F.lit(v)), *more)
        sub = lambda state, v: pattern(o, (site, state), (eb, F.lit(v)))
        held = (enz("1", *atp), sub(off, "1"))
        water = F.struct(F.lit("ATP").alias("monomer"), F.create_map(F.lit("b"), F.lit("2")).alias("sites")).cast(PATTERN)
        free_atp = F.struct(F.lit("ATP").alias("monomer"), F.create_map(F.lit("b"), F.lit(FREE)).alias("sites")).cast(PATTERN)
        bind = rule(_text(rule_text(s), "_", kind, "_bind_", rule_text(o), "_", site), side(enz(FREE), sub(off, FREE)), side((enz("1"), sub(off, "1"))), _text("kf_", ab, "_bind"), "bind")
        loose = rule(_text(plain_name(s["name"]), "_dissoc_", plain_name(o["name"])), side((pattern(s, (sb, F.lit("1")), bare=True), pattern(o, (eb, F.lit("1")), bare=True))), side(pattern(s, (sb, F.lit(FREE)), bare=True), pattern(o, (eb, F.lit(FREE)), bare=True)), _text("kr_", ab, "_bind"), "unbind")
        if policy == "two_step":
            return many(bind, rule(name, side(held), side(enz(FREE), sub(on, FREE)), _text("kc_", ab, "_", mod), "catalyse"), loose)
        taken = rule(_text(rule_text(s), "_bind_atp"), side(pattern(s, (F.lit("ATP"), F.lit(FREE))), free_atp), side((pattern(s, (F.lit("ATP"), F.lit("2"))), water)), _text("kf_", _letters(s), "_atp_bind"), "bind")
        given = rule(_text(plain_name(s["name"]), "_dissoc_atp"), side((pattern(s, (F.lit("ATP"), F.lit("2")), bare=True), water)), side(pattern(s, (F.lit("ATP"), F.lit(FREE)), bare=True), free_atp), _text("kr_", _letters(s), "_atp_bind"), "unbind")
        return many(bind, loose, taken, given, rule(name, side((*held, water)), side(enz(FREE, (F.lit("ATP"), F.lit(FREE))), free_atp, sub(on, FREE)), _text("kc_", ab, "_", mod), "catalyse"))
    enz, before, after = pattern(s), pattern(o, (site, off)), pattern(o, (site, on))
    if policy == "michaelis_menten":
        return many(rule(name, side(enz, before), side(enz, after), _text("kc_", ab, "_", mod), "catalyse", _text("kc_", ab, "_", mod, " / (Km_", ab, "_", mod, " + ", name, "_sub_obs)")))
    return many(rule(name, side(enz, before), side(enz, after), _text("kf_", ab, "_", mod), "modify"))


def _activity(s: Column, o: Column, policy: str) -> Column:
    act = _or(F.col("activity"), "activity")
    up = F.col("stmt_type") != "Inhibition"
    name = _text(rule_text(s), "_", F.when(up, "activates").otherwise("deactivates"), "_", rule_text(o), "_", act)
    ab = _letters(s, o)
    if policy == "interactions_only":
        own = _or(s["activity"]["activity_type"], "activity")
        return many(rule(name, side(pattern(s, (own, F.lit(FREE)), bare=True), pattern(o, (act, F.lit(FREE)), bare=True)), side((pattern(s, (own, F.lit("1")), bare=True), pattern(o, (act, F.lit("1")), bare=True))), F.lit("kf_bind"), "interact"))
    before, after = (pattern(o, (act, F.when(up == b, "inactive").otherwise("active"))) for b in (True, False))
    if policy == "michaelis_menten":
        return many(rule(name, side(pattern(s), before), side(pattern(s), after), _text("kc_", ab, "_act"), "catalyse", _text("kc_", ab, "_act / (Km_", ab, "_act * ", name, "_obj_obs)")))
    return many(rule(name, side(pattern(s), before), side(pattern(s), after), _text("kf_", ab, "_act"), "modify"))


def _switch(s: Column, o: Column, policy: str, sites: tuple[str, str], word: str, on: bool) -> Column:
    """Exchange factors and GTPase activators."""
    name = _text(rule_text(s), "_activates_" if on else "_deactivates_", rule_text(o))
    if policy == "interactions_only":
        return many(rule(name, side(*(pattern(x, (F.lit(site), F.lit(FREE)), bare=True) for x, site in zip((s, o), sites, strict=True))), side(tuple(pattern(x, (F.lit(site), F.lit("1")), bare=True) for x, site in zip((s, o), sites, strict=True))), F.lit("kf_bind"), "interact"))
    a, b = ("inactive", "active") if on else ("active", "inactive")
    state = lambda v: pattern(o, (F.lit("gtpbound"), F.lit(v)))
    return many(rule(name, side(pattern(s), state(a)), side(pattern(s), state(b)), _text("kf_", _letters(s, o), "_", word), "modify"))


def _amount(s: Column, o: Column, policy: str, more: bool) -> Column:
    word, verb, alone = ("synth", "_produces_", "_synthesized") if more else ("deg", "_degrades_", "_degraded")
    if policy == "interactions_only":
        sb, ob = site_name(o["name"]), site_name(s["name"])
        name = _text(rule_text(s), "_", F.lower(F.col("stmt_type")), "_", rule_text(o))
        return F.when(s["name"].isNotNull(), many(rule(name, side(pattern(s, (sb, F.lit(FREE)), bare=True), pattern(o, (ob, F.lit(FREE)), bare=True)), side((pattern(s, (sb, F.lit("1")), bare=True), pattern(o, (ob, F.lit("1")), bare=True))), F.lit("kf_bind"), "interact")))
    made = F.array(plain_name(o["name"])) if more else None
    by, ab = _text(rule_text(s), verb, rule_text(o)), _letters(s, o)
    one = lambda kf, rate, v: rule(by, side(pattern(s)) if more else side(pattern(s), pattern(o)), side(pattern(s)), kf, v, rate, made)
    hill = _text("kf_", ab, "_synth * (", by, "_subj_obs ^ (n_", ab, "_synth - 1)) / (Ka_", ab, "_synth ^ n_", ab, "_synth + ", by, "_subj_obs ^ n_", ab, "_synth)")
    regulated = one(_text("kf_", ab, "_", word), hill, "hill_kf") if more and policy == "hill" else one(_text("kf_", ab, "_", word), None, word)
    free = rule(_text(rule_text(o), alone), side() if more else side(pattern(o)), side(), _text("kf_", _letters(o), "_", word), f"{word}_alone", None, made)
    none = F.array().cast(f"array<{RULE}>")
    return F.when(s["name"].isNull(), many(free)).when(F.lit(more) & (s["name"] == o["name"]), none).otherwise(many(regulated))


def _complex(members: Column, policy: str) -> Column:
    """Members bind pairwise, or all at once with a bond for each pair."""
    n = F.size(members)
    if policy == "multi_way":
        bond = lambda i, j: F.least(i, j) * n + F.greatest(i, j) + 1
        sites = lambda m, i, bound: F.transform(F.filter(F.transform(members, lambda b, j: F.struct(b.alias("b"), j.alias("j"))), lambda x: x["j"] != i), lambda x: _entry(site_name(x["b"]["name"]), bond(i, x["j"]).cast("string") if bound else F.lit(FREE)))
        whole = lambda m, i, bound: F.struct(plain_name(m["name"]).alias("monomer"), F.map_from_entries(F.concat(sites(m, i, bound), F.filter(conditions(m), lambda e: ~F.array_contains(F.transform(members, lambda b: site_name(b["name"])), e["key"])))).alias("sites")).cast(PATTERN)
        free = F.transform(members, lambda m, i: F.array(whole(m, i, False))).cast(SIDE)
        held = F.array(F.transform(members, lambda m, i: whole(m, i, True))).cast(SIDE)
        name = F.array_join(F.transform(members, rule_text), "_")
        letters = F.array_join(F.transform(members, lambda m: F.lower(F.substring(m["name"], 1, 1))), "")
        return many(rule(_text(name, "_bind_fwd"), free, held, _text("kf_", letters, "_bind"), "bind"), rule(_text(name, "_bind_rev"), held, free, _text("kr_", letters, "_bind"), "unbind"))

    def pair(a: Column, b: Column) -> Column:
        sa, sb = site_name(b["name"]), site_name(a["name"])
        at = lambda v, bare=False: (pattern(a, (sa, F.lit(v)), bare=bare), pattern(b, (sb, F.lit(v)), bare=bare))
        bind = rule(_text(rule_text(a), "_", rule_text(b), "_bind"), side(*at(FREE)), side(at("1")), _text("kf_", _letters(a, b), "_bind"), "bind")
        loose = rule(_text(plain_name(a["name"]), "_", plain_name(b["name"]), "_dissociate"), side(at("1", True)), side(*at(FREE, True)), _text("kr_", _letters(a, b), "_bind"), "unbind")
        return many(bind, loose)

    later = lambda i: F.slice(members, i + 2, F.greatest(n - i - 1, F.lit(0)))
    return F.flatten(F.flatten(F.transform(members, lambda a, i: F.transform(later(i), lambda b: pair(a, b)))))


def _translocation(a: Column) -> Column:
    start, end = plain_name(_or(F.col("from_location"), "cytoplasm")), plain_name(F.col("to_location"))
    at = lambda v: side(pattern(a, (F.lit("loc"), v)))
    out = many(rule(_text(rule_text(a), "_translocates_", start, "_to_", end), at(start), at(end), _text("kf_", F.lower(plain_name(a["name"])), "_", start, "_", end), "translocate"))
    return F.when(F.col("to_location").isNotNull(), out)


def _self(s: Column, trans: bool) -> Column:
    site = mod_site(F.lit("phosphorylation"), F.col("residue"), F.col("position"))
    if not trans:
        return many(rule(_text(rule_text(s), "_autophospho_", rule_text(s), "_", site), side(pattern(s, (site, F.lit("u")))), side(pattern(s, (site, F.lit("p")))), _text("kf_", _letters(s), "_autophos"), "autophos"))
    partner = s["bound"][0]["name"]
    other = lambda v: F.struct(plain_name(partner).alias("monomer"), F.create_map(site, F.lit(v)).alias("sites")).cast(PATTERN)
    out = many(rule(_text(rule_text(s), "_transphospho_", plain_name(partner), "_", site), side((pattern(s), other("u"))), side((pattern(s), other("p"))), _text("kf_", _letters(s), F.lower(F.substring(partner, 1, 1)), "_transphos"), "modify"))
    return F.when(partner.isNotNull(), out)


def _conversion(s: Column) -> Column:
    role = lambda r: F.filter(F.col("args"), lambda a: (a["role"] == r) & a["name"].isNotNull())
    before, after = role("obj_from"), role("obj_to")
    old, names = before[0], F.transform(after, lambda a: plain_name(a["name"]))
    made = F.array_join(F.transform(after, rule_text), "_")
    letters = F.concat(F.lower(F.substring(old["name"], 1, 1)), F.lower(F.substring(names[0], 1, 1)))
    alone = rule(_text(rule_text(old), "_converted_to_", made), side(pattern(old)), side(), _text("kf_", letters, "_convert"), "convert_alone", None, names)
    by = rule(_text(rule_text(s), "_catalyzes_", rule_text(old), "_converted_to_", made), side(pattern(s), pattern(old)), side(pattern(s)), _text("kf_", _letters(s), letters, "_convert"), "convert", None, names)
    return F.when((F.size(before) == 1) & (F.size(after) > 0), F.when(s["name"].isNull(), many(alone)).otherwise(many(by)))


def _influence(s: Column, o: Column) -> Column:
    down = F.coalesce(F.col("polarity") == -1, F.lit(False))
    name = _text(rule_text(s), "_", F.when(down, "negatively").otherwise("positively"), "_influences_", rule_text(o))
    param = _text("kf_", _letters(s, o), F.when(down, "_neg").otherwise("_pos"))
    value = F.when(down, RATES["influence_neg"]).otherwise(RATES["influence_pos"])
    both, one = side(pattern(s), pattern(o)), side(pattern(s))
    return many(rule(name, F.when(down, both).otherwise(one), F.when(down, one).otherwise(both), param, value))


POLICIES = {"modification": ("one_step", "two_step", "interactions_only", "atp_dependent", "michaelis_menten"), "regulateactivity": ("one_step", "interactions_only", "michaelis_menten"), "switch": ("one_step", "interactions_only"), "amount": ("one_step", "interactions_only", "hill"), "complex": ("one_step", "multi_way")}


def _packed_args(c: Corpus) -> DataFrame:
    if "args" in c.statements.columns:
        return c.statements
    cols = [x for x in c.agents.columns if x != "stmt_id"]
    return c.statements.join(c.agents.groupBy("stmt_id").agg(F.array_sort(F.collect_list(F.struct(*cols)), lambda x, y: F.when(x["idx"] < y["idx"], -1).when(x["idx"] > y["idx"], 1).otherwise(0)).alias("args")), "stmt_id")


def with_policy(statements: DataFrame, policies: dict[str, str] | str = "one_step", by_id: DataFrame | None = None) -> DataFrame:
    """``policy`` of each assertion: that of its id (``by_id(stmt_id, policy)``), else of its type, else ``other``."""
    table = {"other": policies} if isinstance(policies, str) else {k.lower(): v for k, v in policies.items()}
    other = table.pop("other", "one_step")
    out = statements.withColumn("policy", F.coalesce(picked(table, F.lower("stmt_type")), F.lit(other)))
    if by_id is None:
        return out
    return out.join(by_id.select("stmt_id", F.col("policy").alias("__p")), "stmt_id", "left").withColumn("policy", F.coalesce("__p", "policy")).drop("__p")


def _templates(policy_of) -> Column:
    """Rules of the row's type. ``policy_of(type)`` is the policy of a type where it is known for all its assertions (its template alone is then in the plan), else null: the ``policy`` column tells."""
    s, o = F.col("__s"), F.col("__o")
    members = F.filter("args", lambda a: a["name"].isNotNull())
    both, kind = s["name"].isNotNull() & o["name"].isNotNull(), F.col("stmt_type")

    def choose(kinds: tuple[str, ...], types: tuple[str, ...], fn) -> Column:
        known = {policy_of(t) for t in types}
        if None not in known:
            known = {p if p in kinds else kinds[0] for p in known}
            if len(known) == 1:
                return fn(known.pop())
        out = None
        for p in kinds[1:]:
            if None in known or p in known:
                out = F.when(F.col("policy") == p, fn(p)) if out is None else out.when(F.col("policy") == p, fn(p))
        return fn(kinds[0]) if out is None else out.otherwise(fn(kinds[0]))

    acts, mods, amounts = ("Activation", "Inhibition", "GtpActivation"), tuple(TAKES), POLICIES["amount"]
    return (
        F.when(kind.isin(*mods), F.when(both, choose(POLICIES["modification"], mods, lambda p: _modification(s, o, p))))
        .when(kind.isin(*acts), F.when(both, choose(POLICIES["regulateactivity"], acts, lambda p: _activity(s, o, p))))
        .when(kind == "Gef", F.when(both, choose(POLICIES["switch"], ("Gef",), lambda p: _switch(s, o, p, ("gef_site", "p_loop"), "gef", True))))
        .when(kind == "Gap", F.when(both, choose(POLICIES["switch"], ("Gap",), lambda p: _switch(s, o, p, ("gap_site", "gtp_site"), "gap", False))))
        .when(kind == "IncreaseAmount", F.when(o["name"].isNotNull(), choose(amounts, ("IncreaseAmount",), lambda p: _amount(s, o, p, True))))
        .when(kind == "DecreaseAmount", F.when(o["name"].isNotNull(), choose(amounts[:2], ("DecreaseAmount",), lambda p: _amount(s, o, p, False))))
        .when(kind == "Complex", F.when(F.size(members) > 1, choose(POLICIES["complex"], ("Complex",), lambda p: _complex(members, p))))
        .when(kind == "Translocation", _translocation(s))
        .when(kind == "Autophosphorylation", _self(s, False))
        .when(kind == "Transphosphorylation", _self(s, True))
        .when(kind == "Conversion", _conversion(s))
        .when(kind == "Influence", F.when(both, _influence(s, o)))
    )


def rules(c: Corpus, policies: dict[str, str] | str = "one_step", by_id: DataFrame | None = None) -> DataFrame:
    """(stmt_id, rule, lhs, rhs, param, value, rate): the rules of all assertions, one of each name."""
    rows = with_policy(_packed_args(c), policies, by_id)
    table = {"other": policies} if isinstance(policies, str) else {k.lower(): v for k, v in policies.items()}
    policy_of = lambda t: None if by_id is not None else table.get(t.lower(), table.get("other", "one_step"))
    if "polarity" not in rows.columns:
        rows = rows.withColumn("polarity", F.lit(None).cast("int"))
    arg = lambda i: F.try_element_at(F.filter("args", lambda a: a["idx"] == i), F.lit(1))
    flat = rows.withColumn("__s", arg(0)).withColumn("__o", arg(1)).select("stmt_id", F.explode(_templates(policy_of)).alias("r")).select("stmt_id", "r.*")
    one = flat.groupBy("rule").agg(F.min_by(F.struct("stmt_id", "lhs", "rhs", "made", "param", "value", "rate"), "stmt_id").alias("x")).select("rule", "x.*")
    one = checkpoint(one)  # used for the monomers, too
    # a monomer that is made has its sites free and in their first states
    need = one.where(F.size("made") > 0).select("rule", F.posexplode("made").alias("k", "monomer"))
    look = monomers(one).select("monomer", F.transform_values("sites", lambda k, v: F.when(F.size(v) > 0, v[0]).otherwise(FREE)).alias("sites"))
    blank = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    fresh = F.struct("k", F.struct("monomer", F.coalesce("sites", blank).alias("sites")).cast(PATTERN).alias("p"))
    by_place = lambda x, y: F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0)
    built = need.join(look, "monomer", "left").groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(fresh), by_place), lambda x: F.array(x["p"])).alias("__new"))
    out = one.join(built, "rule", "left").withColumn("rhs", F.when(F.col("__new").isNotNull(), F.concat("rhs", F.col("__new").cast(SIDE))).otherwise(F.col("rhs")))
    return out.select("stmt_id", "rule", "lhs", "rhs", "param", "value", "rate")


def monomers(rule_rows: DataFrame) -> DataFrame:
    """(monomer, sites): of every monomer in the rules its sites, each with its states in order (none: a binding site). A modification's site has both states."""
    flat = rule_rows.select(F.explode(F.flatten(F.concat("lhs", "rhs"))).alias("p")).select("p.monomer", "p.sites")
    made = rule_rows.select(F.explode("made").alias("monomer")).select("monomer", F.lit(None).cast("map<string,string>").alias("sites")) if "made" in rule_rows.columns else None
    flat = flat if made is None else flat.union(made)
    sites = flat.select("monomer", F.explode_outer("sites").alias("site", "value"))
    state = F.when(~F.col("value").rlike(r"^(\.|_|\d+)$"), F.col("value"))
    by = sites.groupBy("monomer", "site").agg(F.array_sort(F.collect_set(state)).alias("found"))
    has = lambda x: F.array_contains("found", x)
    pair = lambda *p: F.array(*(F.lit(x) for x in p))
    full = F.when(has("u") | has("p"), pair("u", "p")).when(has("n") | has("y"), pair("n", "y")).when(has("active") | has("inactive"), pair("inactive", "active")).when(F.col("site") == "loc", F.array_sort(F.array_union("found", pair("cytoplasm")))).otherwise(F.col("found"))
    return by.groupBy("monomer").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("site").isNotNull(), F.struct("site", full.alias("states")))))).alias("sites"))


def initial_conditions(monomer_rows: DataFrame, value: float = INITIAL, expression: DataFrame | None = None, line: str | None = None) -> DataFrame:
    """(monomer, param, value, sites): every monomer free, in its first states (cytoplasm before other places), in the default amount or that of ``expression(name[, line], value)``."""
    first = F.transform_values("sites", lambda k, v: F.when(F.size(v) < 1, FREE).when((k == "loc") & F.array_contains(v, "cytoplasm"), "cytoplasm").otherwise(F.try_element_at(v, F.lit(1))))
    out = monomer_rows.select("monomer", F.concat("monomer", F.lit("_0")).alias("param"), F.lit(float(value)).alias("value"), first.alias("sites"))
    if expression is None:
        return out
    own = expression if line is None else expression.where(F.col("line") == line)
    known = own.groupBy(plain_name(F.col("name")).alias("monomer")).agg(F.max("value").alias("__v"))
    return out.join(known, "monomer", "left").withColumn("value", F.coalesce(F.col("__v").cast("double"), "value")).drop("__v")


def matching_patterns(agents: DataFrame, rule_rows: DataFrame, ignore_activities: bool = False) -> DataFrame:
    """(stmt_id, idx, rule, sites): patterns of the rules over the argument's monomer that hold all its conditions."""
    cols = [x for x in agents.columns if x != "stmt_id"]
    a = agents.select("stmt_id", "idx", F.struct(*cols).alias("a"))
    own = a.select("stmt_id", "idx", plain_name(F.col("a.name")).alias("monomer"), conditions(F.col("a")).alias("c"), F.col("a.activity.activity_type").alias("__t"))
    if ignore_activities:
        own = own.withColumn("c", F.filter("c", lambda e: ~e["key"].eqNullSafe(F.col("__t"))))
    p = rule_rows.select("rule", F.explode(F.flatten(F.concat("lhs", "rhs"))).alias("p")).select("rule", "p.monomer", "p.sites")
    holds = F.forall("c", lambda e: F.try_element_at("sites", e["key"]).eqNullSafe(e["value"]) | ((e["value"] == ANY) & F.coalesce(F.try_element_at("sites", e["key"]) != FREE, F.lit(False))))
    found = own.join(p, "monomer").where(holds)
    return found.select("stmt_id", "idx", "rule", F.array_sort(F.map_entries("sites")).alias("sites")).distinct()


# text

DIALECTS = {"bngl": ("{s}~{v}", "{s}", "{s}!{v}", "{s}!+"), "kappa": ("{s}{{{v}}}", "{s}[.]", "{s}[{v}]", "{s}[_]")}


def pattern_text(p: Column, dialect: str = "bngl") -> Column:
    state, free, bond, bound = DIALECTS[dialect]
    def site(e: Column) -> Column:
        fill = lambda form: F.replace(F.replace(F.lit(form.format(s="\x01", v="\x02")), F.lit("\x01"), e["key"]), F.lit("\x02"), e["value"])
        return F.when(e["value"] == FREE, fill(free)).when(e["value"] == ANY, fill(bound)).when(e["value"].rlike(r"^\d+$"), fill(bond)).otherwise(fill(state))

    return F.concat(p["monomer"], F.lit("("), F.array_join(F.transform(F.array_sort(F.map_entries(p["sites"])), site), ","), F.lit(")"))


def side_text(s: Column, dialect: str = "bngl") -> Column:
    within, between, none = (".", " + ", "0") if dialect == "bngl" else (", ", ", ", ".")
    text = F.array_join(F.transform(s, lambda x: F.array_join(F.transform(x, lambda p: pattern_text(p, dialect)), within)), between)
    return F.when(F.size(s) == 0, none).otherwise(text)


def rule_lines(rule_rows: DataFrame, dialect: str = "bngl") -> DataFrame:
    """(rule, line): rules in a rule language, with their rates."""
    lhs, rhs = side_text(F.col("lhs"), dialect), side_text(F.col("rhs"), dialect)
    line = F.concat(F.col("rule"), F.lit(": "), lhs, F.lit(" -> "), rhs, F.lit(" "), F.col("rate")) if dialect == "bngl" else F.concat(F.lit("'"), F.col("rule"), F.lit("' "), lhs, F.lit(" -> "), rhs, F.lit(" @ '"), F.col("rate"), F.lit("'"))
    return rule_rows.select("rule", line.alias("line"))


def model_lines(c: Corpus, policies: dict[str, str] | str = "one_step", dialect: str = "bngl", expression: DataFrame | None = None) -> DataFrame:
    """(section, key, line): parameters, monomers, starting amounts and rules; a writer sorts by section and key."""
    r = rules(c, policies)
    m = monomers(r)
    start = initial_conditions(m, expression=expression)
    number = lambda v: v.cast("string")
    states = lambda k, v: F.concat(k, F.when(F.size(v) > 0, F.concat(*([F.lit("~"), F.array_join(v, "~")] if dialect == "bngl" else [F.lit("{"), F.array_join(v, " "), F.lit("}")]))).otherwise(""))
    signature = F.concat("monomer", F.lit("("), F.array_join(F.transform(F.array_sort(F.map_entries("sites")), lambda e: states(e["key"], e["value"])), ","), F.lit(")"))
    put = (lambda n, v: F.concat(n, F.lit(" "), v)) if dialect == "bngl" else (lambda n, v: F.concat(F.lit("%var: '"), n, F.lit("' "), v))
    params = r.select("param", "value").union(start.select("param", "value")).groupBy("param").agg(F.min("value").alias("value"))
    begin = start.withColumn("p", F.struct("monomer", "sites").cast(PATTERN))
    parts = (
        (1, params.select(F.col("param").alias("key"), put(F.col("param"), number(F.col("value"))).alias("line"))),
        (2, m.select(F.col("monomer").alias("key"), (F.concat(F.lit("%agent: "), signature) if dialect == "kappa" else signature).alias("line"))),
        (3, begin.select(F.col("monomer").alias("key"), (F.concat(pattern_text(F.col("p"), dialect), F.lit(" "), "param") if dialect == "bngl" else F.concat(F.lit("%init: '"), "param", F.lit("' "), pattern_text(F.col("p"), dialect))).alias("line"))),
        (4, rule_lines(r, dialect).select(F.col("rule").alias("key"), "line")),
    )
    out = None
    for n, df in parts:
        rows = df.select(F.lit(n).alias("section"), "key", "line")
        out = rows if out is None else out.union(rows)
    return out
