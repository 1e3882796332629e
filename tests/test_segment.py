import pytest

from chashma.operators import segment as G

CASES = [
    ("Bugun havo yaxshi. Ertaga yomg'ir yog'adi.", "Bugun havo yaxshi.", set()),
    ("Hamshira S. K. ning arizasi ko'rib chiqildi. Ish davom etdi.", "Hamshira S. K. ning arizasi ko'rib chiqildi.", {"INITIAL_BOUNDARY_PROTECTED"}),
    ("A. Ismoilov yig'ilishda qatnashdi. Majlis yakunlandi.", "A. Ismoilov yig'ilishda qatnashdi.", set()),
    ('"Bu mumkinmi?" deb so\'radi. Javob berildi.', '"Bu mumkinmi?" deb so\'radi.', {"QUOTE_OR_SPEECH_CONTINUATION"}),
    ("Ma'lumot berildi. birinchi bosqich boshlandi.", "Ma'lumot berildi.", {"LOWERCASE_AFTER_TERMINAL"}),
    ("Savdo agenti Sh. T. fuqaro N. ga murojaat qildi. Ish yakunlandi.", "Savdo agenti Sh. T. fuqaro N. ga murojaat qildi.", set()),
    ("Fuqaro J. bir minginchi. ning arizasi ko'rildi. Ish yakunlandi.", "Fuqaro J. bir minginchi. ning arizasi ko'rildi.", {"SUSPICIOUS_ORDINAL_PERIOD_PROTECTED"}),
    ("To'lov beshinchi. MCHJ tomonidan qabul qilindi. Ish yakunlandi.", "To'lov beshinchi. MCHJ tomonidan qabul qilindi.", set()),
    ("Tarkibida organik, minera! moddalar mavjud. Suv tekshirildi.", "Tarkibida organik, minera! moddalar mavjud.", {"LOWERCASE_AFTER_STRONG_PUNCTUATION_PROTECTED"}),
    ("Maydon o'n kv. mga teng. Hisob yakunlandi.", "Maydon o'n kv. mga teng.", set()),
    ("Bu haqda Gazeta. ru xabar berdi. Ish yakunlandi.", "Bu haqda Gazeta. ru xabar berdi.", {"DOTTED_NAME_OR_DOMAIN_PROTECTED"}),
    ("Fuqaro J. bir minginchi. noqonuniy daromad orttirgan. Ish yakunlandi.", "Fuqaro J. bir minginchi. noqonuniy daromad orttirgan.", {"ROMAN_EXPANSION_INITIAL_PROTECTED"}),
    ("   Birinchi gap.   Ikkinchi gap.   ", "Birinchi gap.", set()),
]


@pytest.mark.parametrize("text, first, flags", CASES)
def test_scan(text, first, flags):
    spans = G.scan(text)
    assert len(spans) == 2
    a, b, _, _, found = spans[0]
    assert text[a:b] == first and flags <= set(found)


def test_fragment_and_unprotected():
    assert G.scan("Birinchi gap. Manba: Axborot xizmati")[1][3:] == ("TRAILING_FRAGMENT", ["NO_TERMINAL_PUNCTUATION"])
    assert "DOTTED_NAME_OR_DOMAIN_PROTECTED" not in G.scan("Xabar yakunlandi. Ruhiy holat barqaror.")[0][4]
    assert "ROMAN_EXPANSION_INITIAL_PROTECTED" not in G.scan("U musobaqada birinchi. Keyingi ishtirokchi keldi.")[0][4]
    assert G.scan("") == [] and G.scan(" \n ") == []


def test_records(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(99, None), (100, ""), (101, "So'z 😀 bor. " * 3000)], "id long, text string")
    one, two = G.segment(df, "id", "text"), G.segment(df, "id", "text")
    assert {r.sentence_id for r in one.collect()} == {r.sentence_id for r in two.collect()}
    assert all(r.failing == 0 for r in G.verify(one, df, "id", "text").collect())
    assert one.where("source_record_id = 101").count() == 3000
    merged = G.segment(spark.createDataFrame([(0, "Bugun havo yaxshi, Ertaga yomg'ir yog'adi.")], "id long, text string"), "id", "text")
    changes = G.inventory_diff(one.where("source_record_id = 0"), merged).collect()
    assert [(c.change, c.boundary, c.explained) for c in changes] == [("REMOVED", 18, False)]
