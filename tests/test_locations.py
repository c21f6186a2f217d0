"""Dictionaries read from files, prefixes in one lookup, and owners without a login."""

from millrace.operators import geo, merge


def test_demonyms_and_cities_from_a_file(spark, tmp_path):
    path = str(tmp_path / "phrases.txt")
    spark.createDataFrame([("BR brazilian|brasileiro",), ("PT  Portuguese ",), ("US portland|Portland, OR",), ("CA portland",), ("broken",)], "value string").coalesce(1).write.text(path)
    more = geo.read_phrases(spark, path)
    assert {tuple(r) for r in more.collect()} >= {("brazilian", "BR"), ("brasileiro", "BR"), ("portuguese", "PT"), ("portland", "CA")}
    countries = geo.country_phrases(spark).union(more)
    texts = ["Brazilian developer", "brasileiro", "portuguese speaker", "France", "Paris region", "nowhere", "berlin, somewhere"]
    df = spark.createDataFrame([(t,) for t in texts], "location string")
    got = {r.location: (r.country, r.confidence) for r in geo.resolve_locations(df, countries, geo.city_phrases(spark)).collect()}
    assert got["Brazilian developer"] == ("BR", "name") and got["brasileiro"] == ("BR", "name") and got["portuguese speaker"] == ("PT", "name")
    assert got["Paris region"] == ("FR", "gazetteer-city") and got["France"] == ("FR", "name") and got["nowhere"] == (None, "unmatched")


def test_country_names_are_taken_once(spark):
    first = geo._country_names(spark)
    assert geo._country_names(spark) is first and len(first) > 700


def test_owners_without_a_login(spark):
    schema = "id long, login string, type string"
    old = spark.createDataFrame([(1, None, "User"), (9, "a", "User")], schema)
    new = spark.createDataFrame([(1, None, "User"), (2, None, "User"), (3, "A", "User"), (4, "a", "User"), (5, "b", "User")], schema)
    got = {r.id: r.login for r in merge.upsert_owners(old, new).collect()}
    assert got == {1: None, 2: None, 3: "A", 4: "a~4", 5: "b", 9: "A~9"}
