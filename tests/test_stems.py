"""Stems: the published sample vocabulary, special words, and a plain version of the rules."""

import re

from gleanery.functions import stems

# From the published sample of the algorithm.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori
console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol
consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel
knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit
knitted knit knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock
knocks knock knopp knopp knot knot knots knot""".split()
MORE = """skies sky dying die news news inning inning succeed succeed generate generat generously generous communism communism arsenic arsenic
hopping hop hoped hope hopping hop luxuriated luxuri plotted plot filing file failing fail agreed agre feed feed ties tie cries cri gas gas this this
gaps gap kiwis kiwi happy happi by by say say cry cri relational relat conditional condit digitizer digit analogies analog feudalism feudal
hopefulness hope goodness good adoption adopt adjustment adjust rate rate controlling control roll roll youth youth boyish boyish flying fli
national nation formative format electrical electr sensibilities sensibl dogs' dog dog's dog i i as as bed bed shed shed embed emb beauty beauti""".split()


def pairs(listed):
    return dict(zip(listed[::2], listed[1::2], strict=True))


def test_the_published_sample_and_special_words(spark):
    want = pairs(SAMPLE) | pairs(MORE)
    rows = spark.createDataFrame([(w,) for w in want], "word string")
    got = {r["word"]: r["stem"] for r in stems.stems(rows).collect()}
    assert {w: (got[w], s) for w, s in want.items() if got[w] != s} == {}


def test_stems_come_back_to_every_row(spark):
    rows = spark.createDataFrame([(1, "running"), (2, "running"), (3, None), (4, ""), (5, "zürichs"), (6, "runs")], "id int, word string")
    got = {r["id"]: r["stem"] for r in stems.stemmed(rows).collect()}
    assert got == {1: "run", 2: "run", 3: None, 4: "", 5: "zürich", 6: "run"}
    assert stems.stemmed(rows.where("false")).columns == ["id", "word", "stem"] and stems.stemmed(rows.where("false")).count() == 0
    assert not re.search("Window|Python", stems.stems(rows)._jdf.queryExecution().toString())


def test_stems_of_sentences(spark):
    rows = spark.createDataFrame([(1, "The runners were running. Running, runs! Knives?"), (2, None), (3, "the of and")], "k int, t string")
    got = {(r["k"], r["stem"]): r["n"] for r in stems.sentence_stems(rows, "k", "t").collect()}
    assert got == {(1, "runner"): 1, (1, "run"): 3, (1, "knive"): 1}
