from lorewright.operators.replay import CHUNKS, build_graph


def src(page, text):
    return {"page_number": page, "supporting_text": text}


def entity(i, name, kind, aliases=(), summary="", page=1, facts=None, roles=None):
    return {"temporary_id": i, "name": name, "type": kind, "roles": roles, "aliases": list(aliases), "summary": summary, "sources": [src(page, f"{name} stands here")], "facts": facts}


def edge(s, t, kind, confidence=0.9, text="", page=1):
    return {"source_temporary_id": s, "target_temporary_id": t, "relationship_type": kind, "description": text, "confidence": confidence, "sources": [src(page, text or kind)]}


def chunk(n, entities, relationships):
    return ("camp", f"chunk-{n}", n, {"entities": entities, "relationships": relationships})


def test_chunks_become_a_canonical_graph(spark):
    fact = lambda i, content, page: {"temporary_id": i, "field_key": "motive", "content": content, "sources": [src(page, content)]}
    chunks = [
        chunk(1, [
            entity("e1", "Harlan Stone", "npc", ["H. Stone"], "a smith", facts=[fact("f1", "A quiet life", 1)]), entity("e2", "Oak Keep", "location"), entity("e3", "Northmarch", "location"),
            entity("e4", "Stone", "item"),
        ], [edge("e1", "e2", "Lives in"), edge("e2", "e3", "located in"), edge("e2", "e2", "guards"), edge("e1", "e9", "knows")]),
        chunk(2, [entity("e1", "h stone", "npc", [], "the smith of the keep", 2, [fact("f1", "quiet life", 2), fact("f2", "-", 2)], ["ally"]), entity("e2", "The Keep", "location", ["Oak Keep"], page=2)],
              [edge("e1", "e2", "lives-in", 0.95, "longer description", 2)]),
    ]
    pages = spark.createDataFrame([("camp", 1, "Harlan Stone left Oak Keep. H. Stone came back."), ("camp", 2, "Oak Keep burned, and so did The Keep.")], "campaign_id string, page_number int, text string")
    g = build_graph(spark.createDataFrame(chunks, CHUNKS), pages)
    e = {r.name: r for r in g.entities.collect()}
    assert set(e) == {"Harlan Stone", "Oak Keep", "Northmarch", "Stone"}
    harlan, keep = e["Harlan Stone"], e["Oak Keep"]
    assert harlan.summary == "the smith of the keep" and harlan.roles == ["ally"] and harlan.candidates == 2 and len(harlan.sources) == 2
    assert sorted(harlan.aliases) == ["H. Stone", "h stone"] and keep.aliases == ["The Keep"]
    assert (harlan.mentions, harlan.pages, keep.mentions, keep.pages) == (2, 1, 3, 2)
    edges = {(r.source_id, r.target_id, r.semantic_type): r for r in g.relationships.collect()}
    lives = edges[harlan.key, keep.key, "lives in"]
    assert len(edges) == 2 and lives.candidates == 2 and lives.confidence == 0.95 and lives.description == "longer description" and lives.type == "Lives in"
    assert sorted(r.reason for r in g.rejected.collect()) == ["self edge", "unknown target"]
    assert [(r.child, r.parent) for r in g.tree.collect()] == [(keep.key, e["Northmarch"].key)]
    assert [(r.content, r.evidence, r.sort_order) for r in g.facts.orderBy("sort_order").collect()][0] == ("A quiet life", 2, 0)
    assert harlan.relationships == 1 and keep.relationships == 2 and keep.score == 3 * 2 + 3 + 2 * 2 and keep.prominence == "major"


def test_empty_and_null_collections(spark):
    chunks = spark.createDataFrame([("camp", "chunk-1", 1, {"entities": [], "relationships": None})], CHUNKS)
    pages = spark.createDataFrame([], "campaign_id string, page_number int, text string")
    g = build_graph(chunks, pages)
    assert [x.count() for x in (g.entities, g.relationships, g.facts, g.tree, g.rejected)] == [0] * 5


def test_rejects_need_no_canonical_entities(spark, monkeypatch):
    from lorewright.operators import replay

    made, write = [], replay.materialize
    monkeypatch.setattr(replay, "materialize", lambda df, name: made.append(name) or write(df, name))
    chunks = spark.createDataFrame([chunk(1, [entity("e1", "Ari", "npc")], [edge("e1", "e1", "knows"), edge("e1", "e2", "knows")])], CHUNKS)
    g = build_graph(chunks, spark.createDataFrame([], "campaign_id string, page_number int, text string"))
    assert sorted(r.reason for r in g.rejected.collect()) == ["self edge", "unknown target"] and set(made) == {"chunks", "groups"}
