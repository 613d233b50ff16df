"""File headers (P12-P15) and register extracts."""

import json

from pyspark.sql import functions as F

from regiflow.functions import text, variant


def test_headers(spark):
    good = 'attachment; filename="bilans.xml"'
    mojibake = 'attachment; filename="sprawozdanie_roczne_łódź.pdf"'.encode("utf-8").decode("latin-1")
    cases = [good, mojibake, "attachment", 'attachment; filename="error.txt"',
             'attachment; filename="README"', None, 'attachment; filename="ł.txt"']
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    repaired = text.repair_header(F.col("h"))
    name = text.file_name(repaired)
    out = df.select(name.alias("n"), text.file_extension(name).alias("e"),
                    text.repair_reason(F.col("h")).alias("r")).collect()
    assert [r.n for r in out] == ["bilans.xml", "sprawozdanie_roczne_łódź.pdf", None, "error.txt",
                                  "README", None, None]
    assert [r.e for r in out] == ["xml", "pdf", None, "txt", "README", None, None]
    assert [r.r for r in out] == [None, None, None, None, None, "no_header", "not_latin1"]


def test_archive_entry_name(spark):
    df = spark.createDataFrame([("0000057814", "bilans.xml")], "k string, n string")
    assert df.select(text.archive_entry_name(F.col("k"), F.col("n")).alias("e")).first().e == \
        "0000057814_bilans.xml"


DOMESTIC = {"odpis": {"rodzaj": "Pełny", "dane": {"dzial1": {
    "danePodmiotu": {"nazwa": "ACME SPÓŁKA Z O.O.", "formaPrawna": "SPÓŁKA Z O.O.",
                     "identyfikatory": {"nip": "1234567890", "regon": "123456789"}},
    "siedzibaIAdres": {"siedziba": {"kraj": "POLSKA", "wojewodztwo": "MAZOWIECKIE",
                                    "powiat": "WARSZAWA", "gmina": "WARSZAWA-ŚRÓDMIEŚCIE"},
                       "adres": {"kraj": "POLSKA", "miejscowosc": "WARSZAWA", "kodPocztowy": "00-001",
                                 "ulica": "UL. PROSTA", "nrDomu": "1"},
                       "adresPocztyElektronicznej": "biuro@acme.pl"}}}}}
FOREIGN = {"odpis": {"rodzaj": "Aktualny", "dane": {"dzial1": {
    "danePodmiotu": {},
    "danePodmiotuZagranicznego": {"nazwa": "FOREIGN GMBH", "formaPrawna": "",
                                  "nazwaFormaPrawnaPrzedsiebiorcyZagranicznego": "GMBH",
                                  "identyfikatory": {"nip": "111", "regon": "222"}},
    "siedzibaIAdresPodmiotuZagranicznego": {"siedziba": {"powiat": "P", "gmina": "G"},
                                            "adres": {"kraj": "NIEMCY", "miejscowosc": "BERLIN"}}}}}}
HISTORY = {"odpis": {"rodzaj": "Pełny", "dane": {"dzial1": {
    "danePodmiotu": {"nazwa": ["OLD NAME", "NEW NAME"], "formaPrawna": "SA",
                     "identyfikatory": {"nip": "9", "regon": "8"}},
    "siedzibaIAdres": {"adres": {"miejscowosc": ["KRAKÓW", "GDAŃSK"]}}}}}}


def test_company_record(spark):
    docs = [json.dumps(DOMESTIC, ensure_ascii=False), json.dumps(FOREIGN), json.dumps(HISTORY),
            "{not json", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, raw string")
    out = variant.company_record(df, "raw", keep=["i"]).withColumnRenamed("extract_kind", "kind").orderBy("i").collect()
    assert variant.extract_kind(F.col("raw")) is not None
    d, f, h, bad, none = out
    assert d.kind == "Pełny" and d.full_name == "ACME SPÓŁKA Z O.O."
    assert (d.county, d.municipality) == ("WARSZAWA", "WARSZAWA-ŚRÓDMIEŚCIE")   # not swapped
    assert d.email == "biuro@acme.pl" and d.webpage is None and d.postal_number == "00-001"
    assert f.full_name == "FOREIGN GMBH" and f.legal_form == "GMBH" and f.city == "BERLIN"
    assert f.country == "NIEMCY" and f.nip_number == "111"
    assert h.full_name == "NEW NAME" and h.city == "GDAŃSK"          # history list: last entry
    assert bad.kind is None and bad.full_name is None
    assert none.kind is None and none.city is None


def test_first_present_is_python_or(spark):
    df = spark.createDataFrame([('{"a": "", "b": "x"}',), ('{"a": "y", "b": "x"}',),
                                ('{"a": {}, "b": 0}',), ('{"b": null}',)], "j string")
    v = variant.parse(F.col("j"))
    pick = variant.first_present(variant.get(v, "$.a", "variant"), variant.get(v, "$.b", "variant"))
    got = [r.p for r in df.select(F.to_json(pick).alias("p")).collect()]
    assert got == ['"x"', '"y"', "0", "null"]


def test_field_history_of_scalars_lists_and_objects(spark):
    import json

    def raw(entity, seat=None):
        return json.dumps({"odpis": {"rodzaj": "Pełny", "dane": {"dzial1": {"danePodmiotu": entity, "siedzibaIAdres": seat or {}}}}})

    extracts = [
        ("list", raw({"nazwa": ["Old", "New ŻÓŁĆ"], "formaPrawna": "SA", "identyfikatory": {"nip": [{"nip": "1", "wpis": 2}], "regon": 12}})),
        ("odd", raw({"nazwa": [["a", "b"], None, True, 1.5], "formaPrawna": []}, {"adres": {"kraj": None, "ulica": {"x": 1}}})),
        ("foreign", json.dumps({"odpis": {"dane": {"dzial1": {"danePodmiotu": {}, "danePodmiotuZagranicznego": {"nazwa": "GmbH"}}}}})),
        ("broken", "{"), ("null", None), ("empty", "{}")]
    df = spark.createDataFrame(extracts, "k string, raw_data string")
    got = sorted((r.k, r.field, r.entry, r.value, r.is_last) for r in variant.field_history(df, keep=["k"]).collect())
    assert got == sorted([
        ("list", "full_name", 0, "Old", False), ("list", "full_name", 1, "New ŻÓŁĆ", True), ("list", "legal_form", 0, "SA", True),
        ("list", "nip_number", 0, '{"nip":"1","wpis":2}', True), ("list", "regon_number", 0, "12", True),
        ("odd", "full_name", 0, '["a","b"]', False), ("odd", "full_name", 1, None, False), ("odd", "full_name", 2, "true", False),
        ("odd", "full_name", 3, "1.5", True), ("odd", "street", 0, '{"x":1}', True), ("foreign", "full_name", 0, "GmbH", True)],
        key=lambda r: (r[0], r[1], r[2]))
    last = {(r.k, r.field): r.value for r in variant.field_history(df, keep=["k"]).filter("is_last").collect()}
    record = {r.k: r for r in variant.company_record(df, keep=["k"]).collect()}
    assert all(record[k][field] == value for (k, field), value in last.items() if not (value or "").startswith("{"))


def test_field_history_explodes_without_a_shuffle(spark):
    df = spark.createDataFrame([("a", "{}")], "k string, raw_data string")
    plan = variant.field_history(df, keep=["k"])._jdf.queryExecution().executedPlan().toString()
    assert "variant_explode" in plan and "Exchange" not in plan and "Python" not in plan
