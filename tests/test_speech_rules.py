"""Attribution and the rules for questions and answers on invented Chinese passages, with what is expected of each."""

from pyspark.sql import functions as F

from loomline.functions import text as t
from loomline.operators import dialogue

#: Passages, the lines that are 阿明's, and those that could be anyone's.
PASSAGES = [
    ("阿明说道：“我们先回家吧。”老李点头。", "我们先回家吧。", ""),
    ("“你从哪里来呢？”老李问道。夜里很静。", "", ""),
    ("“今天的风真大啊。”没有人回应。", "", "今天的风真大啊。"),
    ("“走这边的小路。”阿明低声说。“慢一点再慢一点。”", "走这边的小路。|慢一点再慢一点。", ""),
    ("这里没有引号。", "", ""),
]

#: Questions to 阿明 (who knows 老李), and whether each is unfit.
ASKED = [("你昨天去了哪里？", False), ("老李，你好吗今天", True), ("老李会不会回来呢？", True), ("阿明，老李会来吗？", False), ("王教授，明天去哪里？", True), ("为什么？", True), ("（笑）你去哪里了呢？", True), ("说说那座桥……", True), ("那条河后来怎么样了？", False)]

#: Answers with known facts, and whether each is to be generated again.
ANSWERED = [("我在河边。", "", False), ("不是风而是雨。", "", True), ("从七岁那年开始我就在这里。", "", True), ("从七岁那年开始我就在这里。", "童年在河边", False), ("你说呢？", "", True), ("走", "", True), ("等等...", "", True), ("他走了，难道你不知道？", "", True)]


def test_speakers(spark):
    rows = spark.createDataFrame([(i, "阿明", p) for i, (p, _, _) in enumerate(PASSAGES)], "id int, name string, text string")
    got = dialogue.attributed(rows, 8).orderBy("id").collect()
    assert [("|".join(r.strict), "|".join(r.ambiguous)) for r in got] == [(a, b) for _, a, b in PASSAGES]


def test_questions(spark):
    rows = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(ASKED)], "id int, q string")
    got = rows.select("id", t.bad_question(F.col("q"), F.lit("阿明"), F.array(F.lit("老李"))).alias("bad")).orderBy("id").collect()
    assert [r.bad for r in got] == [b for _, b in ASKED]


def test_answers(spark):
    rows = spark.createDataFrame([(i, a, k) for i, (a, k, _) in enumerate(ANSWERED)], "id int, a string, k string")
    got = rows.select("id", t.bad_answer(F.col("a"), F.array("k"), F.array().cast("array<string>")).alias("bad")).orderBy("id").collect()
    assert [r.bad for r in got] == [b for _, _, b in ANSWERED]
