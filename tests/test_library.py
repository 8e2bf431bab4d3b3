"""Library functions and operators by example and against plain Python."""

import itertools
import json
import random
import time
from html import unescape

import pytest
from pyspark.sql import functions as F

from quern.functions import folding, hazards, rules, text
from quern.operators import census, dictionary, filters, nested, relational, resolve
from quern.sources import publish


def column(spark, values, f, extra=()):
    rows = spark.createDataFrame([(k, *v) if isinstance(v, tuple) else (k, v) for k, v in enumerate(values)], "k int, " + ", ".join(f"{c} string" for c in ("a", "b")[: 2 if isinstance(values[0], tuple) else 1]))
    return [r["r"] for r in rows.select("k", f.alias("r")).orderBy("k").collect()]


def test_entities(spark):
    known = ["&amp;lt;", "a&#39;b&rsquo;c&ndash;", "&#x1F600;&eacute;&Eacute;&nbsp;", "no entity & none;", "", "&hellip;&copy;&frac12;&amp;&amp;", "&fjlig;"]
    assert column(spark, known, text.decode_entities(F.col("a"))) == [unescape(v) for v in known]
    kept = ["&#0;", "&#7;", "&#xD800;", "&#1114112;", "&nosuchname;", "&#x80;", "&amp"]
    assert column(spark, [*kept, None], text.decode_entities(F.col("a"))) == [*kept, None]


def test_places(spark):
    firms = ["Acme Foods of Springfield, Illinois", "Acme of Austin, TX", "Acme, of New York, N.Y.", "House of Spices, XY", "House of Spices", "Acme of Raleigh, North Carolina.", "Acme of Fargo, ND"]
    assert column(spark, firms, text.strip_location(F.col("a"))) == ["Acme Foods", "Acme", "Acme", "House of Spices, XY", "House of Spices", "Acme", "Acme"]


def test_folding(spark):
    forms = column(spark, ["Café Crème", "CAFE CREME", "Straße", "ﬁne № ½", "Ångström-Öl", None, "日本 x"], folding.word_form(F.col("a")))
    assert forms == ["CAFE CREME", "CAFE CREME", "STRASSE", "FINE NO 1 2", "ANGSTROM OL", None, "X"]
    pairs = [("Café Crème", "cafe CREME"), ("a", "b"), ("résumé", "resume"), ("", "")]
    assert column(spark, pairs, folding.equal_letters(F.col("a"), F.col("b"))) == [True, False, True, True]
    inside = [("Le café crème chaud", "CAFE creme"), ("Crème brûlée", "cr"), ("x", ""), (None, "x")]
    assert column(spark, inside, folding.contains_words(F.col("a"), F.col("b"))) == [True, False, False, False]
    one = column(spark, ["Übel & Söhne Foods, Inc. Co"], folding.firm_forms(F.col("a")))[0]
    assert tuple(one) == ("UBEL SOHNE FOODS", "UBEL SOHNE FOODS INC", "ÜBELSÖHNEFOODS", "UBEL SOHNE", "übel and söhne foods, inc. co", "ubelsohnefoodsincco")
    assert len(set(one)) == 6


def test_hazards(spark):
    said = ["May contain Listeria", "E. coli O157:H7 found", "undeclared EGGS and milk", "cGMP deviations", "metallic print", "lead; pieces of glass", "leads to nothing", None, "under-processed"]
    assert column(spark, said, F.array_join(hazards.hazard_classes(F.col("a")), "|")) == ["bacteria", "bacteria", "allergen", "bad practice", "", "foreign body|heavy metal", "", "", "bad practice"]
    assert column(spark, said, hazards.is_process_fault(F.col("a"))) == [True, True, False, True, False, True, False, False, True]
    plain = column(spark, said, hazards.plain_reason(F.col("a")))
    assert [p and p["sentence"] for p in plain] == ["May carry germs that make people ill: listeria.", "May carry germs that make people ill.", "The label is silent about egg, to which people may be allergic.", "Was not made as the rules ask.", None, "There may be pieces of glass in it.", None, None, "Was not made as the rules ask."]


def test_split_faults(spark):
    rows = [(["A", "b &amp; c"], "A B & C", "b &amp; c", "A", True), (["A", "x"], "A B", "x", "A", True), (["A B"], "A B", "A B", "Z", True), (["A", "B"], "A B", "B", "b", True), (["A", "B"], "A B", "B", "A", False), (["A", None, "!"], "A", "!", "B", True), (["A", "B"], "A B", None, "A", True)]
    found = spark.createDataFrame(rows, "p array<string>, n string, t string, m string, s boolean").select(rules.split_fault(F.col("p"), F.col("n"), F.col("t"), F.col("m"), F.col("s")).alias("r")).collect()
    assert [r["r"] for r in found] == [None, "differs", "undivided", "says_maker", "unsure", "wordless", "untitled"]


def test_spellings_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdeiost", k=rng.randint(1, 16))) for _ in range(120)]

    def changed(w):
        w = list(w)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "e"])
        return "".join(w)

    left, right = [*base, None, "", "abcdef"], [changed(w) for w in base for _ in range(3)] + ["abcdxx", "abcxxx", None]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b) for a in set(left) for b in set(right) if a is not None and b is not None and (a == b or (min(len(a), len(b)) >= 6 and distance(a, b) <= 0.34 * max(len(a), len(b))))}
    found = resolve.spellings(spark.createDataFrame([(w,) for w in left], "a string"), spark.createDataFrame([(w,) for w in right], "b string"))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_widening_with_guards(spark):
    keys = spark.createDataFrame([(1, "titanium dioxide", []), (2, "aspartame", None), (3, "lead", []), (4, "chromium compound", ["hexavalent"]), (5, "", []), (6, None, [])], "key_id int, key string, needs array<string>")
    names = ["titanium dioxide", "coated titanium dioxide color", "titanium dioxide free color", "free of titanium dioxide", "dioxide titanium", "aspartame blend", "no aspartame", "notes on aspartame", "lead", "lead pipe", "chromium compound salt", "hexavalent chromium compound salt", "", None]
    named = spark.createDataFrame(list(enumerate(names)), "name_id int, name string")
    found = {(r["key_id"], r["name_id"], r["how"]) for r in resolve.widened(keys, named).collect()}
    assert found == {(1, 0, "exact"), (1, 1, "contains"), (2, 5, "contains"), (2, 7, "contains"), (3, 8, "exact"), (4, 11, "contains")}


def test_cascade_shows_rungs_only_what_is_open(spark):
    rows, seen = spark.createDataFrame([(k, f"n{k}") for k in range(6)], "k int, name string"), []

    def rung(targets):
        def find(open_rows):
            seen.append(sorted(r["k"] for r in open_rows.collect()))
            return open_rows.join(spark.createDataFrame(targets, "j int, target string"), F.col("k") == F.col("j"))

        return find

    found = resolve.cascade(spark, rows, "k", [("one", rung([(0, "a"), (1, "b"), (1, "b")])), ("two", rung([(0, "z"), (2, "c"), (2, "d"), (3, "e")]))]).orderBy("k").collect()
    assert [tuple(r) for r in found] == [(0, "one", "a", None), (1, "one", "b", None), (2, "two", None, 2), (3, "two", "e", None), (4, "none", None, None), (5, "none", None, None)]
    assert seen == [[0, 1, 2, 3, 4, 5], [2, 3, 4, 5]]


def test_rewriting_stops_and_is_idempotent(spark):
    again = [("^(the|new|organic) ", ""), (r"(.*) \1$", "$1"), (" +", " ")]
    said = ["the new the organic milk", "a a a a", "plain", "", None, "the " * 30 + "end"]
    once = column(spark, said, resolve.rewritten(F.col("a"), again))
    assert [(r["text"], r["rounds"], r["settled"]) for r in once[:4]] == [("milk", 4, True), ("a", 2, True), ("plain", 0, True), ("", 0, True)]
    assert once[4]["text"] is None and once[5]["rounds"] == 9 and not once[5]["settled"]
    twice = column(spark, [r["text"] for r in once[:4]], resolve.rewritten(F.col("a"), again))
    assert [r["text"] for r in twice] == [r["text"] for r in once[:4]] and all(r["rounds"] == 0 for r in twice)


def test_disagreements(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "cc"), (4, "Ä")], "k int, s string")
    assert resolve.disagreements(rows, "k", F.length("s") > 1, "length(s) > 1").count() == 0
    found = resolve.disagreements(rows, "k", F.coalesce(F.col("s"), F.lit("")), "s", 4).collect()
    assert [tuple(r) for r in found] == [(2, "", None)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_read_children_once(spark, data):
    part, lines = spark.read.parquet(f"{data}/part.parquet"), spark.read.parquet(f"{data}/lineitem.parquet")
    registry = {"a": "l_quantity > 10", "b": "l_tax > 0.01", "c": "l_discount = 0", "d": "l_returnflag = 'R'", "e": "l_quantity < 2", "f": "l_tax = 0"}
    h, n = filters.Has, filters.Not
    tree = filters.All((filters.AnyOf((n(h("a")), h("b"), n(h("c")))), n(filters.All((h("d"), n(h("e")), h("f"), n(h("a")))))))
    found = filters.matching(part, "p_partkey", tree, registry, lines, "l_partkey")
    assert plan_of(found).count("l_partkey") and plan_of(found).lower().count("relation [l_") == 1
    other = filters.All((n(filters.All((n(h("a")), h("f"), h("d"), n(n(n(h("e"))))))), filters.All((filters.AnyOf((filters.AnyOf((h("b"), n(h("a")))), n(h("c")), h("b"))),))))
    assert filters.normal(tree) == filters.normal(other)
    with pytest.raises(ValueError):
        filters.matching(part, "p_partkey", h("unknown"), registry, lines, "l_partkey")


def test_filter_trees_equal_plain_logic(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["red ring", "Blue", None])) for k in range(40)]
    children = [(rng.choice([*range(30), None]), rng.choice(["x", "y", "z", None]), rng.choice([True, True, False])) for _ in range(70)]
    registry = {"x": "v = 'x'", "y": "v = 'y'"}

    def tree(depth):
        kind = rng.choice(["has", "clear", "text", "in"] if depth == 0 else ["all", "any", "not", "has"])
        parts = tuple(tree(depth - 1) for _ in range(rng.randint(0, 3))) if kind in ("all", "any") else ()
        return {"all": filters.All(parts), "any": filters.AnyOf(parts), "has": filters.Has(rng.choice("xy")), "clear": filters.Clear(rng.choice("xy")), "text": filters.Text("name", "RED"), "in": filters.Within("name", ("Blue",))}.get(kind) or filters.Not(tree(depth - 1))

    def holds(t, row):
        mine = [c for c in children if c[0] == row[0]]
        if isinstance(t, filters.Text):
            return "red" in (row[1] or "").lower()
        if isinstance(t, filters.Within):
            return row[1] in t.values
        if isinstance(t, filters.Has):
            return any(c[1] == t.term for c in mine)
        if isinstance(t, filters.Clear):
            return bool(mine) and all(c[2] for c in mine) and not any(c[1] == t.term for c in mine)
        if isinstance(t, filters.Not):
            return not holds(t.part, row)
        return (all if isinstance(t, filters.All) else any)(holds(p, row) for p in t.parts)

    left, right = spark.createDataFrame(rows, "k int, name string"), spark.createDataFrame(children, "of int, v string, ok boolean")
    for _ in range(8):
        t = tree(3)
        found = filters.matching(left, "k", t, registry, right, "of", assessed=F.col("ok"))
        assert sorted(r["k"] for r in found.collect()) == [r[0] for r in rows if holds(t, r)], t


def test_requests():
    registry = {"milk": "", "egg": "", "soy": ""}
    parsed = filters.parse("text=Oat%20%20milk&without=soy,milk&with=egg&without=milk&without=gluten&text=x&text=" + "y" * 80, registry)
    assert parsed == [("without", "milk"), ("with", "egg"), ("without", "soy"), ("text", "oat milk")]
    assert filters.parse(filters.to_query(parsed), registry) == parsed
    assert filters.toggled(filters.toggled(parsed, ("without", "egg"), registry), ("without", "egg"), registry) == parsed
    assert filters.dispatched("400638 1333931", "code", "n", "b") == filters.Within("code", ("4006381333931",))
    assert filters.dispatched("036000291452", "code", "n", "b") == filters.Within("code", ("0036000291452",))
    assert isinstance(filters.dispatched("4006381333932", "code", "n", "b"), filters.All)
    assert filters.dispatched("!?", "code", "n", "b") == filters.Text("n", "!?")


def test_walk_and_census(spark):
    rng = random.Random(4)

    def value(depth):
        kind = rng.choice(["o", "a", "s", "n", "b", "0"] if depth else ["s", "n", "b", "0"])
        return {"o": lambda: {rng.choice("pqr"): value(depth - 1) for _ in range(rng.randint(0, 3))}, "a": lambda: [value(depth - 1) for _ in range(rng.randint(0, 3))], "s": lambda: rng.choice("uvw"), "n": lambda: rng.randint(0, 99), "b": lambda: rng.random() < 0.5, "0": lambda: None}[kind]()

    records = [value(5) for _ in range(60)]
    want = []

    def visit(k, path, v):
        kind = "OBJECT" if isinstance(v, dict) else "ARRAY" if isinstance(v, list) else "BOOLEAN" if isinstance(v, bool) else "BIGINT" if isinstance(v, int) else "STRING" if isinstance(v, str) else "VOID"
        want.append((k, path, kind, None if isinstance(v, (dict, list)) or v is None else str(v).lower() if isinstance(v, bool) else str(v)))
        for name, inner in v.items() if isinstance(v, dict) else ((None, x) for x in v) if isinstance(v, list) else ():
            visit(k, path + ("[*]" if name is None else "." + name), inner)

    for k, r in enumerate(records):
        visit(k, "$", r)
    texts = [json.dumps(r) for r in records] + ["{broken", None]
    walked = census.walk(spark, spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t")
    assert sorted(map(str, map(tuple, walked.collect()))) == sorted(map(str, [*want, (60, "$", "malformed", None)]))
    counted = {(r["path"], r["type"]): r for r in census.census(walked, "id", vocabulary=3).collect()}
    for (path, kind), group in itertools.groupby(sorted(want, key=lambda w: w[1:3]), key=lambda w: w[1:3]):
        rows = list(group)
        words = sorted({w[3] for w in rows if w[3] is not None})
        r = counted[path, kind]
        assert (r["n"], r["records"], r["words"]) == (len(rows), len({w[0] for w in rows}), words if 0 < len(words) <= 3 else None)


def test_readers_see_all_of_a_version_or_none(spark, tmp_path):
    rows = spark.createDataFrame([(1, "5", "2024-01-31"), (2, "x", "2024-02-30"), (3, None, None)], "id int, n string, d string")
    made = []

    def derive(good):
        made.append("a")
        return good.select("id", "n")

    def broken(good):
        raise RuntimeError("stopped between two tables")

    types, where = {"n": "bigint", "d": "date"}, publish.Publication(spark, f"file://{tmp_path}/shelf")
    with pytest.raises(RuntimeError):
        publish.ingest(where, "run1", rows, types, {"a": derive, "b": broken})
    assert where.versions() == [] and where.manifest() == {"run": None, "tables": {}}
    with pytest.raises(ValueError):
        where.publish("run1", ["a", "b"])
    number = publish.ingest(where, "run1", rows, types, {"a": derive, "b": lambda good: good.where("d IS NULL").select("id")})
    assert number == 1 and made == ["a"]  # the table that was complete isn't made again
    assert sorted(map(tuple, where.table("a").collect())) == [(1, 5), (3, None)]
    assert [tuple(r) for r in where.table("refused").collect()] == [(2, "x", "2024-02-30", "n is no bigint; d is no date")]
    with pytest.raises(RuntimeError):
        publish.ingest(where, "run2", rows.where("id < 3"), types, {"a": derive, "b": broken})
    assert where.table("a").count() == 2 and where.table("b").count() == 1
    publish.ingest(where, "run2", rows.where("id < 3"), types, {"a": derive, "b": lambda good: good.select("id")})
    assert where.versions() == [1, 2] and where.table("a").count() == 1 and where.table("a", 1).count() == 2


def test_probing(spark):
    probes = [("front", "$.front.full", [("too small", "^small$")]), ("any", "$.images[0]", []), ("old", "$.old", [])]
    records = ['{"front": {"full": "big"}}', '{"front": {"full": "small"}, "images": ["x"]}', '{"old": " o "}', "{}", "no json"]
    found = column(spark, records, census.probed(F.try_parse_json(F.col("a")), probes))
    assert [tuple(r) for r in found] == [("big", "front", []), ("x", "any", ["front: too small"]), ("o", "old", ["front: absent", "any: absent"]), (None, None, ["front: absent", "any: absent", "old: absent"]), (None, None, ["front: absent", "any: absent", "old: absent"])]


def test_categories_by_example(spark):
    terms = spark.createDataFrame([("chocolate", "Chocolate", 1), ("milk chocolate", "Chocolate", 0), ("cream", "Dairy", 0), ("coffee", "Coffee", 1), ("ice cream", "Ice Cream", 0), ("bar", "Snack", 2), ("ice", None, 3)], "term string, category string, tier int")
    names = ["Milk Chocolates with Cream", "Coffee Ice Cream", "Coffee Flavored Bars", "Bar of Coffee, Chocolate", "With Cream", "Ice", "", None]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    found = {r["id"]: (r["category"], r["term"]) for r in dictionary.categorise(rows, "id", "name", terms).collect()}
    assert found == {0: ("Chocolate", "milk chocolate"), 1: ("Ice Cream", "ice cream"), 2: ("Snack", "bar"), 3: ("Coffee", "coffee"), 4: ("Dairy", "cream")}


def test_compounds_by_example(spark):
    known = spark.createDataFrame([("canola oil",), ("sunflower oil",), ("salt",), ("pepper",), (None,)], "name string")
    names = ["canola and/or sunflower oil", "canola and sunflower oil", "salt & pepper", "salt and vinegar", "salt, or pepper", "macaroni and cheese and salt", "oil", "", None, "salt and pepper", " or "]
    found = {}
    for r in dictionary.compounds(spark.createDataFrame(list(enumerate(names)), "id int, n string"), "id", "n", known, ["oil"]).orderBy("id", "part").collect():
        found.setdefault(r["id"], []).append(r["item"])
    two = ["canola oil", "sunflower oil"]
    assert found == {0: two, 1: two, 2: ["salt", "pepper"], 3: ["salt and vinegar"], 4: ["salt", "pepper"], 5: ["macaroni and cheese and salt"], 6: ["oil"], 9: ["salt", "pepper"]}


def test_nouns_and_orientation(spark):
    used = spark.createDataFrame([(f"nice {w}", m) for w in ("crackers", "cracker") for m in range(3)] + [("x, fresh", m) for m in range(5)] + [("rare thing", 1), (None, 2), ("", 3)], "name string, maker int")
    lexicon = dictionary.nouns(used, "name", "maker", makers=3)
    assert [r["noun"] for r in lexicon.collect()] == ["cracker"]
    names = ["Oat & Honey, Crackers", "Crackers, Oat", "Cracker, Crackers", "a, b", "one", "a, b, cracker", None, ""]
    found = dictionary.oriented(spark.createDataFrame(list(enumerate(names)), "id int, n string"), "id", "n", lexicon).orderBy("id").collect()
    assert [(r["title"], r["secondary"]) for r in found] == [("Crackers", "Oat & Honey"), ("Crackers", "Oat"), ("Cracker", "Crackers"), ("a", "b"), ("one", None), ("a, b, cracker", None), (None, None), ("", None)]


def test_families_and_codes(spark):
    table = spark.createDataFrame([("e1", "B", 2), ("e2", "A", 1), ("e3", "B", 0), ("e1", "C", 5)], "code string, name string, place int")
    rows = spark.createDataFrame([(1, "e1"), (1, "e2"), (1, "e3"), (1, "e9"), (2, None), (3, "e1")], "k int, c string")
    found = dictionary.families(rows, "k", "c", table).orderBy("k").collect()
    assert [(r["k"], r["names"], r["unknown"]) for r in found] == [(1, ["B", "A"], 1), (2, [], 0), (3, ["B"], 0)]
    assert column(spark, ["cancer, Developmental", "female", "", None], F.array_join(dictionary.codes_of(F.col("a"), [("c", "cancer"), ("d", "develop"), ("f", "female"), ("c", "^cancer")]), "|")) == ["c|d", "f", "", ""]


def test_names_that_agree(spark):
    pairs = [("Kellogg's", "KELLOGGS Raisin Bran"), ("365", "365 Whole Foods Market"), ("Clif", "CLIF BAR"), ("Red", "Red Gold"), ("", ""), (None, "x"), ("Wegmans Organic", "WEGMANS"), ("Ab", "Ab cd"), ("Übel", "UBEL & Söhne")]
    assert column(spark, pairs, folding.names_agree(F.col("a"), F.col("b"), ["RED"])) == [True, True, True, False, False, False, True, False, True]
    legal = [("Kashi", "Kashi Company LLC"), ("Kashl Company", "Kashi Company"), ("Pepperidge Farm", "Peperidge Farms Inc"), ("Oreo", "Mondelez"), ("", "x"), (None, "x")]
    assert column(spark, legal, folding.spells_legal_name(F.col("a"), F.col("b"), ["company", "llc", "inc"])) == [True, True, True, False, False, False]


def _plain_pairs(bag, seeds):
    """Sets and, for each owner, its rarest elements, in plain Python."""
    sets = {}
    for o, e in bag:
        if o is not None and e is not None:
            sets.setdefault(o, set()).add(e)
    spread = {}
    for es in sets.values():
        for e in es:
            spread[e] = spread.get(e, 0) + 1
    return sets, {o: sorted(es, key=lambda e: (spread[e], e))[:seeds] for o, es in sets.items()}


@pytest.mark.parametrize("carried", [64, 3, 0])
def test_sets_are_compared_where_they_meet(spark, carried):
    rng = random.Random(3)
    bag = [(rng.randrange(60), rng.randrange(40)) for _ in range(400)] + [(1, e) for e in range(30)] + [(None, 3), (5, None), (7, 7), (7, 7)]
    rows = spark.createDataFrame(bag, "o long, e long")
    sets, rare = _plain_pairs(bag, 2)
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    met = {(min(a, b), max(a, b)) for a in sets for b in sets if a != b and set(rare[a]) & sets[b]}
    similar = relational.similar_sets(rows, "o", "e", 2, 0.2, carried)
    assert sorted(tuple(r) for r in similar.collect()) == sorted((a, b, len(sets[a] & sets[b]), like(a, b)) for a, b in met if like(a, b) >= 0.2)
    firsts = {e: sorted(o for o in sets if e in sets[o])[:5] for e in {e for es in sets.values() for e in es}}
    wanted = []
    for a in sets:
        others = {b for e in rare[a] for b in firsts[e] if b != a}
        order = sorted(others, key=lambda b: (-like(a, b), -len(sets[a] & sets[b]), b))[:3]
        wanted += [(a, b, len(sets[a] & sets[b]), like(a, b), k + 1) for k, b in enumerate(order)]
    related = relational.related_sets(rows, "o", "e", 2, 5, 3, carried)
    assert sorted(tuple(r) for r in related.collect()) == sorted(wanted)


def test_sets_that_meet_are_not_shuffled_pair_by_pair(spark):
    """2,000 owners share 20 elements, so that 99,000 pairs meet; few are alike."""
    rows = spark.range(6000).select((F.col("id") % 2000).alias("o"), F.when(F.col("id") < 2000, F.col("id") % 20).otherwise(F.col("id") + 100).alias("e"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    assert relational.similar_sets(rows, "o", "e", 3, 0.9).count() == 0
    assert relational.related_sets(rows, "o", "e", 3, 50, 2).count() == 4000
    time.sleep(1)
    assert written() - before < 150_000


@pytest.mark.parametrize(
    ("expression", "most"),
    [
        (lambda t: folding.unmarked(t), 1),
        (lambda t: folding.contains_words(t, F.col("phrase")), 1),
        (lambda t: folding.spells_legal_name(t, F.col("legal"), ["inc"]), 3),
        (lambda t: folding.names_agree(t, F.col("other"), ["RED"]), 1),
        (lambda t: hazards.hazard_classes(t), 1),
        (lambda t: hazards.plain_reason(t), 1),
        (lambda t: nested.statements(t), 1),
    ],
)
def test_long_texts_are_brought_into_their_forms_once(spark, expression, most):
    assert str(expression(F.col("the_text"))).count("the_text") <= most


@pytest.mark.parametrize("most", [100_000, 0])
def test_keys_meet_names_by_either_join(spark, monkeypatch, most):
    monkeypatch.setattr(resolve, "FEW", most)
    keys = spark.createDataFrame([(1, "red bolt", ["new"]), (2, "red bolt", []), (3, "gearbox", None), (4, "x", []), (5, None, [])], "key_id long, key string, needs array<string>")
    names = spark.createDataFrame([(1, "red bolt"), (2, "a new red bolt"), (3, "no red bolt"), (4, "one gearbox here"), (5, None), (6, "an x y")], "name_id long, name string")
    found = resolve.widened(keys, names)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "exact"), (1, 2, "contains"), (2, 1, "exact"), (2, 2, "contains"), (3, 4, "contains")]
    if most:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [word" in plan
