from collections import defaultdict

from pyspark.sql import functions as F

from foliant.llm.lookalikes import keyed, members, one_form, same_look_pairs, skeleton

SAME = [("Café", "Café", "Ｃafé", "C​afé", "Саfé", "Cаfе́"), ("a b", "a b", "a b", "a　b"), ("人二", "⼈⼆"), ("office", "oﬃce"), ("co-op", "co‑op", "co‐op"), ("ガ", "ガ"), ("Зима в Келуве", "Зимa в Keлуве"), ("A", "Ꭺ", "ᗅ", "Α"), ("S", "Ꮪ"), ("o", "ⲟ"), ("B", "ꓐ"), ("h", "հ"), ("é", "е́")]
OTHER = [("2", "²"), ("1", "①"), ("iii", "ⁱⁱⁱ"), ("e", "é"), ("e", "ë"), ("ต", "ค"), ("ş", "ș"), ("في", "فى"), ("a", "A"), ("a.", "a!"), ("0", "O"), ("ab", "a b"), ("1", "l"), ("l", "I"), ("rn", "m"), ("o", "O"), ("2024", "2O24"), ("“a”", "\"a\""), ("ø", "o"), ("ı", "l")]


def test_skeletons(spark):
    for group in SAME:
        assert len({skeleton(x) for x in group}) == 1, group
        assert len({one_form(x) for x in group}) == 1, group
    for a, b in OTHER:
        assert skeleton(a) != skeleton(b)
    for own in ("Ένα μικρό βιβλίο", "Как тихо здесь", "カメラとロボット", "二人は力士", "آخر الفانوس", "और भाई", "Ærø", "գիրք"):
        assert one_form(own) == own
    assert one_form("Писмо из Кутаpода") == "Писмо из Кутарода" and one_form("ЅÃО JОÃО") == "SÃO JOÃO"


def test_pairs_against_brute_force(spark):
    texts = [None, "", "  ", "Café", "Café", "Café", "Саfé", "other", "othеr", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("skeleton_key", F.lit(1))
    keys = keyed(df, "id", "text").withColumn("field", F.lit("t"))
    want = sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a and b and a.strip() and b.strip() and a != b and skeleton(a) == skeleton(b))
    for block in (1, 2, 50_000):
        assert sorted((r.id_a, r.id_b) for r in same_look_pairs(keys, ["field"], block).collect()) == want
    assert same_look_pairs(keys.limit(0), ["field"]).count() == 0
    got = {r.id: (r.class_id, r.n, r.several) for r in members(keys, ["field"]).collect()}
    for i in got:
        alike = [j for j in got if skeleton(texts[j]) == skeleton(texts[i])]
        assert got[i] == (min(alike), len(alike), len({texts[j] for j in alike}) > 1)


def test_one_form_depends_on_the_skeleton(spark, sf):
    forms = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/books.parquet").collect():
        forms[skeleton(r.book_title)].add(one_form(r.book_title))
    assert all(len(v) == 1 for v in forms.values())
