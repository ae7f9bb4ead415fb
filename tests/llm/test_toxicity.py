import random

from dayloom.llm import toxicity as x

WORDS = "the river boat child evening tower stone garden quiet number window market".split()


def tables(spark, n=400):
    rng, docs, labels = random.Random(3), [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["blorp", "zanker", "grumfast"])
        docs.append((i, " ".join(words) + ". " + " ".join(rng.choices(WORDS, k=9)), "c"))
        labels.append((i, int(i % 4 == 0)))
    family = " ".join(["oddity", *WORDS])  # copies of one toxic text: its other words are no insults
    docs += [(n + i, f"{family} blorp tail{i}", "c") for i in range(40)] + [(n + 50, f"oddity {i}", "c") for i in range(3)]
    labels += [(n + i, 1) for i in range(40)]
    docs += [(900, None, "c"), (901, "", "c"), (902, "river " * 30_000 + "BLORP!", "c"), (None, "blorp", "c")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (None, 1), (5, None), (8, 0)], "doc_id long, toxic int")


def test_grammar(spark):
    docs, labels = tables(spark)
    grammar = x.fit_grammar(x.labelled_sample(docs, labels, "toxic", 3, 1))
    assert "blorp$" in grammar.insults and "oddity$" not in grammar.insults and "river$" not in grammar.insults
    rows = x.score_documents(docs, grammar).collect()
    assert len(rows) == docs.count()
    for r in rows:
        bad = any(w in (r.text or "").lower() for w in ("blorp", "zanker", "grumfast"))
        assert (r.score >= x.THRESHOLD) == bad and 0 <= r.score <= 1
    assert x.score_documents(docs.limit(0), grammar).collect() == []
    assert len({r.score for r in rows if r.text in (None, "")}) == 1


def test_no_toxic_labels(spark):
    docs, labels = tables(spark, 12)
    grammar = x.fit_grammar(x.labelled_sample(docs, labels.where("toxic = 0"), "toxic", 3, 1))
    assert grammar.score("blorp") < 1e-9
    assert x.fit_grammar(x.labelled_sample(docs.limit(0), labels, "toxic", 3, 1)).score("") < 1e-9


def test_clauses():
    g = x.Grammar({"fool$": 3.0, "idio": 2.0}, [-5.0, -4.0, 1.0, 0.0], -6.0)
    assert g.weigh("A fool. Next")[0] == 3.0
    assert g.weigh("he is not a fool; idiotic")[0] == 2.0  # negation ends with its clause
    assert g.weigh("you fool")[0] == 4.0 and g.weigh("you fool")[1] == "you fool"
    assert g.weigh("she wrote fool")[0] == 0.0
    assert g.weigh("foolish unfool")[0] == -6.0
    words = "x " * 5000
    assert g.weigh(words + "fool" + " y" * 5000)[0] == 3.0


def test_threats_and_order():
    g = x.Grammar({"fool$": 3.0}, [-5.0, -4.0, 1.0, 0.5], -6.0)
    assert g.weigh("Well. I will kill you! So")[0] == x.MENACE and g.weigh("Well. I will kill you! So")[1] == "i will kill you"
    assert g.score("ich werde dich töten") >= x.THRESHOLD and x.Grammar().score("you will die") >= x.THRESHOLD
    assert g.score("they kill time") >= x.THRESHOLD and g.weigh("kill the lights")[0] == -6.0 and g.weigh("you. kill")[0] == -6.0
    assert g.weigh("I will not kill you")[0] == x.MENACE - 5 and g.weigh("I will kill you not")[0] == x.MENACE
    assert g.weigh("a fool, not wise")[0] == 3.0 and g.weigh("no fool")[0] == -2.0  # only what is read before
    assert g.weigh("fool that you are")[0] == 4.0 and g.weigh("beat a fool")[0] == 3.5 and g.weigh("skill you")[0] == -6.0
    assert g.weigh("you " + "x " * 5000 + "fool" + " y" * 5000)[0] == 4.0  # the whole clause is read


def test_threat_weight_is_learned(spark):
    docs, labels = tables(spark)
    y = [(3000 + i, f"you beat {i}") for i in range(12)]
    more = docs.union(spark.createDataFrame([(i, t, "c") for i, t in y], docs.schema))
    some = labels.union(spark.createDataFrame([(i, 0) for i, _ in y], labels.schema))
    assert x.fit_grammar(x.labelled_sample(docs, labels, "toxic", 3, 1)).menace == x.MENACE  # no text has one
    grammar = x.fit_grammar(x.labelled_sample(more, some, "toxic", 3, 1))
    assert grammar.menace < 0 and grammar.score("you beat") < x.THRESHOLD


def test_scope_of_negation():
    g = x.Grammar({"fool$": 3.0}, [-5.0, -4.0, 1.0, 0.0], -6.0)
    assert g.weigh("you are a fool and the sky is not blue")[0] == 4.0  # behind the insult
    assert g.weigh("the sky is not blue and you are a fool")[0] == 4.0  # up to the conjunction
    assert g.weigh("not " + "x " * 20 + "a fool")[0] == 3.0 and g.weigh("not such a fool")[0] == -2.0
    assert g.weigh("you are no fool but a fool")[0] == 4.0


def slow(g, words):
    """All choices of an insult, or of a threat and a target, one by one."""
    read, found = list(g.read(words)), []

    def negated(i):
        for j in range(i - 1, max(-1, i - x.SCOPE - 1), -1):
            if read[j][0] == "conjunction":
                return False
            if read[j][0] == "negation":
                return True
        return False

    for i, (symbol, weight) in enumerate(read):
        before = [s for s, _ in read[:i]]
        if symbol == "insult":
            on = (negated(i), "report" in before, "target" in [s for k, (s, _) in enumerate(read) if k != i], "threat" in before)
            found.append(weight + sum(c for c, o in zip(g.context, on) if o))
        if symbol == "threat" and "target" in [s for s, _ in read]:
            found.append(g.menace + g.context[0] * negated(i) + g.context[1] * ("report" in before))
    return max(found, default=None)


def test_composition_against_brute_force():
    rng = random.Random(11)
    for _ in range(3000):
        g = x.Grammar({"fool$": 3.0, "idio": rng.choice([1.0, 2.0])}, [-rng.choice([2.0, 5.0]), -4.0, 1.0, 0.5], -6.0, rng.choice([0.5, 2.0]))
        words = rng.choices(["fool", "idiotic", "not", "said", "you", "kill", "and", "a", "b"], k=rng.randrange(12))
        found = g.clause(words)
        assert (found and found[0]) == slow(g, words), words


def test_equal_texts_that_disagree_are_left_out(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(10)] + [(20, "other"), (21, "third")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(20, 1), (21, 1)], "doc_id long, toxic int")
    assert {r.text for r in x.labelled_sample(docs, labels, "toxic", 99991, 5).collect()} <= {"other", "third"}
