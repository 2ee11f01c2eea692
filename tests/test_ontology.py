"""Ontology files as tables."""

from lodestone.sources import ontology

TEXT = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">
  <owl:Ontology rdf:about="http://x.org/o"/>
  <owl:Class rdf:about="http://x.org/o#Animal"><rdfs:subClassOf rdf:resource="http://www.w3.org/2002/07/owl#Thing"/><rdfs:comment xml:lang="en"> What lives </rdfs:comment></owl:Class>
  <owl:Class rdf:about="http://x.org/o#Pet"/>
  <owl:Class rdf:about="http://x.org/o#Dog">
    <rdfs:subClassOf rdf:resource="http://x.org/o#Animal"/>
    <rdfs:subClassOf rdf:resource="http://x.org/o#Pet"/>
    <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://x.org/o#eats"/></owl:Restriction></rdfs:subClassOf>
    <rdfs:comment>Barks &amp; bites</rdfs:comment>
  </owl:Class>
  <owl:Class rdf:about="http://x.org/o/Puppy"><rdfs:subClassOf rdf:resource="http://x.org/o#Dog"/></owl:Class>
  <owl:Class rdf:about="http://x.org/o/Puppy"><rdfs:subClassOf rdf:resource="http://x.org/o#Pet"/></owl:Class>
  <owl:Class rdf:ID="A"><rdfs:subClassOf rdf:resource="#B"/></owl:Class>
  <owl:Class rdf:ID="B"><rdfs:subClassOf rdf:resource="#A"/><rdfs:subClassOf rdf:resource="#B"/></owl:Class>
  <owl:ObjectProperty rdf:about="http://x.org/o#eats"><rdfs:domain rdf:resource="http://x.org/o#Animal"/><rdfs:range rdf:resource="http://x.org/o#Pet"/></owl:ObjectProperty>
  <owl:DatatypeProperty rdf:about="http://x.org/o#age"><rdfs:domain rdf:resource="http://x.org/o#Animal"/><rdfs:range rdf:resource="http://www.w3.org/2001/XMLSchema#int"/><rdfs:comment>In years</rdfs:comment></owl:DatatypeProperty>
  <owl:ObjectProperty rdf:about="http://x.org/o#likes"/>
</rdf:RDF>
"""


def test_classes_properties_and_ancestors(spark, tmp_path):
    (tmp_path / "o.owl").write_text(TEXT)
    path, o = str(tmp_path / "o.owl"), "http://x.org/o"
    found = ontology.classes(spark, path)
    assert sorted(tuple(r) for r in found.collect()) == sorted([
        (f"{o}#Animal", "Animal", [], ["age", "eats"], "What lives"),
        (f"{o}#Pet", "Pet", [], [], None),
        (f"{o}#Dog", "Dog", [f"{o}#Animal", f"{o}#Pet"], [], "Barks & bites"),
        (f"{o}/Puppy", "Puppy", [f"{o}#Dog", f"{o}#Pet"], [], None),
        ("#A", "A", ["#B"], [], None),
        ("#B", "B", ["#A", "#B"], [], None),
    ])
    assert sorted((r["name"], r["kind"], r["domain"], r["range"], r["description"]) for r in ontology.properties(spark, path).collect()) == [
        ("age", "data", f"{o}#Animal", "http://www.w3.org/2001/XMLSchema#int", "In years"),
        ("eats", "object", f"{o}#Animal", f"{o}#Pet", None),
        ("likes", "object", None, None, None),
    ]
    assert sorted(tuple(r) for r in ontology.ancestors(found).collect()) == sorted([
        (f"{o}#Dog", f"{o}#Animal", 1), (f"{o}#Dog", f"{o}#Pet", 1),
        (f"{o}/Puppy", f"{o}#Dog", 1), (f"{o}/Puppy", f"{o}#Pet", 1), (f"{o}/Puppy", f"{o}#Animal", 2),
        ("#A", "#B", 1), ("#B", "#A", 1),
    ])


def test_no_classes(spark, tmp_path):
    (tmp_path / "o.owl").write_text("<rdf:RDF></rdf:RDF>")
    found = ontology.classes(spark, str(tmp_path / "o.owl"))
    assert found.count() == ontology.ancestors(found).count() == ontology.properties(spark, str(tmp_path / "o.owl")).count() == 0
