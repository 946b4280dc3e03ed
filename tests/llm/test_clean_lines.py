import corpus_pipeline

from tidemark.llm import quality_rules


def site(host, first, n, extra="", line="  Terms OF use apply "):
    """n texts of a host with a line in common, of which less than half is lost."""
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    return [(i, f"{own(i)}\n\n{line}\n{own(-i)}\nterms of use apply{extra}", host, 7) for i in range(first, first + n)]


def table(spark):
    rows = site("a", 100, 21) + site("b", 200, 20) + site(None, 300, 21, "\n ")
    rows += [rows[0], (900, "terms of use apply\none two", "a", 7), (901, "a quiet text of more than ten words that has no line in common", "a", 7)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")


def plain(rows):
    """Hosts a and null have the line in over 20 distinct texts, b has it in 20; 900 has too few words."""
    out = []
    for i, t, s, n in rows:
        if s != "b" and i < 900:
            t = "\n".join(x for x in t.split("\n") if x.strip().lower() != "terms of use apply")
            n = len(t)
        if i != 900:
            out.append((i, t, s, n))
    return sorted(out, key=str)


def test_boilerplate_is_cut_from_kept_texts(spark):
    rows, docs = table(spark)
    got = quality_rules.clean_good(docs, n_chars="n_chars")
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    assert got.count() == quality_rules.keep_good(docs).count()


def test_depleted_texts_are_rejected_and_not_cut_to_a_rest(spark):
    rows = [(i, f"one two three four five six seven eight nine ten eleven common\nw{i}", "a", 1) for i in range(21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    assert quality_rules.clean_good(docs).count() == 0


def test_pipeline_stage_cuts(spark):
    rows, docs = table(spark)
    assert sorted((tuple(r) for r in corpus_pipeline.rules(spark, docs, "").collect()), key=str) == plain(rows)
