import pytest
from conftest import rows

from epiquery.sources import readers as R
from epiquery.sources import writers as W
from epiquery.streaming import jobs as J


def test_label_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("label,is_not_disease,is_pathogen,is_promed_label,parent_label,not_human_disease,is_category,wiki_link,synonym,Non-HM,comments\n Flu ,TRUE,FALSE,,Virus,,?,x,,,\n,,,,,,,,,,\n")
    got = R.label_csv(spark, str(tmp_path / "l.csv")).collect()
    assert len(got) == 1 and got[0].label == "Flu" and got[0].is_not_disease is True and got[0].is_category is None and got[0].parent_label == "Virus"


def test_lists_json_triples(spark, tmp_path):
    (tmp_path / "l.yaml").write_text("- Flu\n- 'Ebola'\n")
    assert rows(R.label_list(spark, str(tmp_path / "l.yaml"))) == [("Ebola",), ("Flu",)]
    (tmp_path / "t.nt").write_text('<http://x/a#D1> <http://w/label> "Flu"@en .\n<http://x/a#D1> <http://w/subClassOf> <http://x/a#D0> .\nrubbish\n')
    assert rows(R.rdf_triples(spark, str(tmp_path / "t.nt"))) == [("D1", "label", "Flu"), ("D1", "subClassOf", "D0")]
    (tmp_path / "c.json").write_text('[{"id": "1", "created": "2014", "labels": ["a"], "content": "c"}]')
    assert R.curated_items(spark, str(tmp_path / "c.json")).first().labels == ["a"]
    (tmp_path / "o.xml").write_text('<rdf><owl:Class rdf:about="http://x#A"><rdfs:label>Alpha</rdfs:label><rdfs:subClassOf rdf:resource="http://x#B"/></owl:Class></rdf>'.replace("<rdf>", '<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s">').replace("</rdf>", "</rdf:RDF>"))
    assert rows(R.rdf_xml(spark, str(tmp_path / "o.xml"))) == [("A", "label", "Alpha"), ("A", "subClassOf", "B")]


def test_sheets_and_versions(spark):
    raw = spark.createDataFrame([('cb({"feed": {"entry": [{"type": "eha/host", "keyword": " bat ", "synonyms": "a, b,"}, {"type": "", "keyword": "x"}]}});',)], "value string")
    assert rows(R.sheet_rows(raw)) == [("eha/host", "bat", ["a", "b"])]
    assert R.sheet_key("https://docs.example/spreadsheets/d/K1/edit") == R.sheet_key("https://docs.example/ccc?key=K1") == "K1"
    n = spark.createDataFrame([("ontologies-9.p",), ("ontologies-10.p",), ("other-99.p",)], "f string")
    assert tuple(R.newest_version(n, "f", "ontologies-").first()) == ("ontologies-10.p", 10)


def test_collections(spark, tmp_path):
    k = spark.createDataFrame([("bat", "wordnet/hosts"), ("flu", "hm/disease"), ("x", "none")], "keyword string, category string")
    W.save_collections(k, str(tmp_path / "k"))
    assert rows(spark.read.parquet(str(tmp_path / "k")).select("keyword", "collection")) == [("bat", "hosts"), ("flu", "diseases")]
    with pytest.raises(ValueError):
        W.save_collections(k.union(k), str(tmp_path / "k2"))


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, t string").write.parquet(str(tmp_path / "in"))
    q = J.diagnose_stream(J.file_stream(spark, str(tmp_path / "in"), "id bigint, t string"), lambda d: d.selectExpr("id", "upper(t) as t"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id", "t")) == [(1, "A"), (2, "B")]


def test_breaker():
    b = J.Breaker(most=1, rest=10)
    for t in (0, 1):
        assert b.allows(t)
        b.record(False, t)
    assert not b.allows(5) and b.allows(11)


def test_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('''@prefix o: <http://x.org/o#> . # a comment
PREFIX r: <http://www.w3.org/2000/01/rdf-schema#>
<http://x.org/o#a> a o:Class ; r:label "Bog; or \\"fen\\"."@en , "Moor"^^<http://x.org/string> ;
  r:subClassOf o:b ; o:part [ o:q "skipped" ; o:z (1 2) ] ; o:note """two
lines""" .
o:b r:label "Wet. land" .
''')
    (tmp_path / "b.ttl").write_text("")
    got = rows(R.turtle_triples(spark, f"{tmp_path}/a.ttl", f"{tmp_path}/b.ttl", f"{tmp_path}/missing.ttl"))
    assert got == sorted([("a", "type", "Class"), ("a", "label", 'Bog; or "fen".'), ("a", "label", "Moor"), ("a", "subClassOf", "b"), ("a", "note", "two\nlines"), ("b", "label", "Wet. land")], key=repr)
    assert R.turtle_triples(spark, f"{tmp_path}/missing.ttl").count() == 0


def test_rdf_xml_synonyms_and_definitions(spark, tmp_path):
    (tmp_path / "o.owl").write_text("""<rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o" xmlns:oboInOwl="i" xmlns:obo="b">
<owl:Class rdf:about="http://x/DOID_4"><rdfs:label lang="en">disease</rdfs:label></owl:Class>
<owl:Class rdf:about="http://x/DOID_5"><rdfs:label lang="en">flu</rdfs:label><oboInOwl:hasExactSynonym type="t">grippe</oboInOwl:hasExactSynonym><oboInOwl:hasNarrowSynonym type="t">bird flu</oboInOwl:hasNarrowSynonym>
<obo:IAO_0000115 type="t">A disease that has_symptom fever.</obo:IAO_0000115><rdfs:subClassOf rdf:resource="http://x/DOID_4"/></owl:Class></rdf:RDF>""")
    assert rows(R.rdf_xml(spark, f"{tmp_path}/o.owl")) == sorted([("DOID_4", "label", "disease"), ("DOID_5", "label", "flu"), ("DOID_5", "hasExactSynonym", "grippe"), ("DOID_5", "hasNarrowSynonym", "bird flu"), ("DOID_5", "definition", "A disease that has_symptom fever."), ("DOID_5", "subClassOf", "DOID_4")], key=repr)


def test_senses_in_order(spark, tmp_path):
    (tmp_path / "s.json").write_text("\n".join(f'{{"synset": "{s}", "pos": "{s.split(".")[1]}", "lemmas": ["host", "x"], "hyponyms": ["h"]}}' for s in ("host.n.10", "host.n.02", "host.v.01", "army.n.01")))
    w = R.synsets(spark, f"{tmp_path}/s.json")
    assert [r.synset for r in R.senses(w, "host").collect()] == ["army.n.01", "host.v.01", "host.n.02", "host.n.10"]
    assert [r.synset for r in R.senses(w, "host", 1, 3, nouns_only=True).collect()] == ["host.n.02", "host.n.10"] and R.senses(w, "none").count() == 0


def test_mining_saves_and_compares(spark, tmp_path):
    from epiquery.operators import service as SV

    one = spark.createDataFrame([(["flu", "grippe", "bad"], ["disease", None], "hm/disease")], "synonyms array<string>, parent_synonyms array<string>, category string")
    two = spark.createDataFrame([(["Fever", "flu"], [], "eha/symptom")], one.schema)
    assert SV.mine([one], f"{tmp_path}/k", ["bad"]) == {"keywords": 2, "new": 2, "removed": 0}
    assert SV.mine([two], f"{tmp_path}/k") == {"keywords": 2, "new": 1, "removed": 1}
    with pytest.raises(Exception, match="untrimmed keyword"):
        SV.mine([spark.createDataFrame([(["a\t"], [], "x")], one.schema)], f"{tmp_path}/k")
