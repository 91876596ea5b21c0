import numpy as np
import pytest
from pyspark.sql import functions as F

from forgeline.llm.abuse import Kernel, abuse_rates, fit_machine, pieces, plain, scored_documents, training_documents

DATA = "/root/testdata/sf0.1"
CLEAN = ["The pump was cleaned on monday.", "Please quote for 12 pieces of pipe.", "The seal leaks at the stem again.", "Grease nipple and female connector were in order.", "Delivery is expected in 3 weeks."]
BAD = ["You are a stupid idiot and everybody knows it.", "Shut your mouth, you filthy idiot.", "Only an idiot would order this."]


def corpus():
    docs, y = [], []
    for i in range(60):
        text = " ".join(CLEAN[(i + k) % 5] for k in range(3))
        bad = i % 6 == 0
        docs.append(text + (" " + BAD[i // 6 % 3] if bad else ""))
        y.append(int(bad))
    return docs, y


def test_plain():
    assert plain("u​seless") == "useless" and plain("mоrоn") == "moron" and plain("stüpid") == "stupid"
    assert plain("i d i o t") == "idiot" and plain("i.d.i.o.t") == "idiot" and plain("1d10t") == "idiot" and plain("stuuuupid") == "stupid"
    assert pieces("") == [] and pieces("...") == [] and pieces("Valve DN50, 12 mm") == ["valve dn0 0 mm"]


def test_kernel_tolerates_insertions():
    k = Kernel()
    t = k.table(["you stupid idiot", "the valve was opened"])
    a, b = k.project(["you stu.pid idi.ot"], t)[0], k.project(["closed the pipe again"], t)[0]
    assert a[0] > 5 * a[1] and a[0] > 5 * b[0]
    u = np.random.default_rng(0).standard_normal(1 << k.bits).astype(np.float32)
    one = np.array([k.project([x], u)[0] for x in ("abcde", "x", "some longer text")])
    assert np.allclose(one, k.project(["abcde", "x", "some longer text"], u), atol=1e-3)


def test_machine():
    docs, y = corpus()
    m = fit_machine(docs, y)
    s = m.documents(["The pump leaks. You 1diot!", CLEAN[0], "", "you filthy i d i o t"])
    assert s[0] > s[1] and s[3] > s[1] and s[2] < 0
    assert fit_machine([], []).documents(["you idiot"])[0] < 0
    assert fit_machine(docs[:3], [0, 0, 0]).documents(["you idiot"])[0] < 0


def test_commas_do_not_part_a_statement():
    assert pieces("The valve leaks. Get lost, you useless fool, nobody wants you.") == ["the valve leaks get lost you useless fool nobody wants you"]
    assert pieces("Du Idiot, ich sperre dich ein") == ["du idiot ich sperre dich ein"]


def test_wrong_judgements():
    """Clean documents judged abusive teach nothing of their rarer lines; a statement judged clean by mistake is found."""
    who, what = ["planner", "buyer", "fitter", "welder", "inspector", "clerk"], ["idiot", "moron", "cretin", "clown", "loser"]
    rare = [
        "Outline the order in which drains open.",
        "Subject: hose class 150 rating.",
        "Three witnesses describe one outage.",
        "Torque to 40 Nm in two steps.",
        "Grind near warehouse nine before painting.",
        "Vibration at gearbox reached 7 mm/s.",
        "Propose a cartridge for slurry duty.",
        "Copper lugs were counted twice yesterday.",
    ]
    docs, y = [], []
    for i in range(600):
        text = [CLEAN[(i + k) % 5] for k in range(3)]
        bad = i % 6 == 0
        if bad:
            text.insert(i % 3, f"The {who[i // 6 % 6]} is a stupid {what[i // 6 % 5]} and everybody knows it." if i % 4 else "Your dog must be ashamed of you.")
        elif i % 75 == 1:
            text.insert(0, rare[i // 75])
        wrong = i % 75 == 1 or i in (60, 180)  # 8 clean ones judged abusive, 2 abusive ones judged clean
        docs.append(" ".join(text))
        y.append(int(bad != wrong))
    m = fit_machine(docs, y)
    assert (m.documents(rare) < 0.2).all()
    s = m.documents(["Your dog must be ashamed of you.", f"{CLEAN[2]} The buyer is a stupid clown and everybody knows it."])
    assert (s > 0.2).all()
    assert (m.documents(CLEAN) <= -1).all()


def test_documents(spark):
    docs, y = corpus()
    d = spark.createDataFrame([(i, t, " Forum " if i % 2 else None, 0.5) for i, t in enumerate(docs)] + [(100, None, "x", 0.1), (101, "", "x", 0.1)], "doc_id long, text string, source string, score double")
    lab = spark.createDataFrame([(i, v, "r") for i, v in enumerate(y)] + [(0, 1, "r2"), (1, 1, "r2"), (999, 1, "r"), (None, 1, "r")], "doc_id long, abusive int, text string")
    assert training_documents(d, lab, 3, 5).groupBy("y").count().orderBy("y").collect() == [(0, 5), (1, 3)]
    r = scored_documents(d, lab)
    assert r.count() == 62 and r.where("doc_id >= 100 and abusive").count() == 0
    rate = {x.source: x for x in abuse_rates(r).collect()}
    assert rate["forum"].documents == 30 and 0 <= rate[""].share <= 1
    assert scored_documents(d, lab.limit(0)).where("abusive").count() == 0
    assert scored_documents(d.limit(0), lab).count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir(DATA), reason="no test data")
def test_held_out(spark):
    """Area under the curve on documents kept back, against judgements of which some are wrong."""
    d = spark.read.parquet(DATA + "/documents.parquet")
    lab = spark.read.parquet(DATA + "/doc_labels.parquet")
    kept = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    rows = lab.where(kept).join(d, "doc_id").groupBy("doc_id").agg(F.first("text").alias("text"), F.avg("abusive").alias("y")).where("y <> 0.5").collect()
    train = training_documents(d.where(~kept), lab.where(~kept)).toPandas()
    s = fit_machine(train["text"].tolist(), train["y"].astype(int).tolist()).documents([r.text for r in rows])
    y = np.array([r.y > 0.5 for r in rows])
    auc = (s[y][:, None] > s[~y][None, :]).mean()
    assert auc > 0.75
