from haulage.llm.suffix_decontamination import contamination_report, longest_matches


def test_matches_in_the_last_words_of_an_item_are_found(spark):
    docs = spark.createDataFrame([(4, "zero b c d e f g h i zero"), (6, "m n o p q r s")], "doc_id long, text string")
    items = spark.createDataFrame([("nine", "a b c d e f g h i"), ("tail", "t0 t1 t2 t3 t4 t5 m n o p q r"), ("last", "x y z s")],
                                  "item_id string, text string")
    want = [("last", 1, 3, 6, 6), ("nine", 8, 1, 4, 1), ("tail", 6, 6, 6, 0)]
    assert sorted(map(tuple, longest_matches(docs, items).collect())) == want
    assert contamination_report(docs, items).where("contaminated OR n_items > 0").count() == 0
