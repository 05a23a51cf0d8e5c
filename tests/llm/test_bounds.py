"""Bounds on samples leave something to learn from, and stages drop no rows."""

import pytest

from corpusmill.llm import near_join, quality, toxicity


def test_the_first_example_stays_however_long_it_is(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k} and others of example {k}") for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    for bound in (1, 8):
        monkeypatch.setattr(toxicity, "MAX_POSTINGS", bound)
        assert len(toxicity.fit(docs, labels).norm) == 1
    one = docs.where("doc_id = 1")
    monkeypatch.setattr(toxicity, "MAX_POSTINGS", 1)
    assert len(toxicity.fit(one, labels).norm) == 1


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    same = " ".join(f"x{k}" for k in range(60))
    other = "quite another text with words of its own"
    rows = [("b", same, "1"), ("b", other, "2"), ("a", same + " y", "3"), ("c", "alone among the rows", "4"), ("c", "alone among the rows", "4"), (None, same, "5"), ("d", None, "6"), ("e", "", "7"), ("a", other, "8")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _row string")
    kept = near_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["_row"] for r in kept.collect()) == ["3", "4", "5", "6", "7", "8"]


PROSE = {
    "Chinese": "今天早上我们一起去公园散步，看到许多人在湖边练习太极拳，孩子们在草地上追逐奔跑，老人们坐在长椅上聊天，天气非常好，微风吹过树梢，远处传来悠扬的音乐声，大家都觉得心情愉快，于是决定下个周末再来这里，带上食物和饮料，好好享受一天的时光。",
    "Japanese": "今朝は家族みんなで公園へ散歩に出かけ、湖のほとりで太極拳をしている人たちや、芝生の上を走り回る子どもたち、ベンチに座って話をしているお年寄りの姿を眺めながら、ゆっくりとした時間を過ごすことができて、とても気持ちのよい一日になりました。",
    "Hindi": "आज सुबह हम सब लोग पार्क में टहलने गए और वहाँ झील के किनारे बहुत से लोगों को व्यायाम करते हुए देखा और बच्चे घास पर दौड़ रहे थे।",
    "Arabic": "هل ذهبت هذا الصباح مع العائلة إلى الحديقة لتمشي حول البحيرة وترى الناس وهم يمارسون الرياضة والأطفال وهم يركضون على العشب الأخضر؟",
    "Urdu": "آج صبح ہم سب پارک میں سیر کے لیے گئے اور جھیل کے کنارے بہت سے لوگوں کو ورزش کرتے ہوئے دیکھا اور بچے گھاس پر دوڑ رہے تھے۔",
    "Amharic": "ዛሬ ጠዋት ከቤተሰቦቼ ጋር ወደ መናፈሻ ሄደን በሐይቁ ዳር ብዙ ሰዎች ስፖርት ሲሠሩ አየን ልጆችም በሣሩ ላይ ይሮጡ ነበር ቀኑም በጣም ደስ የሚል ነበር።",
    "Thai": "เช้านี้เราทั้งครอบครัวออกไปเดินเล่นที่สวนสาธารณะ เห็นคนจำนวนมากออกกำลังกายริมทะเลสาบ และเด็กๆ วิ่งเล่นกันบนสนามหญ้าอย่างสนุกสนาน",
    "Lao": "ເຊົ້ານີ້ພວກເຮົາທັງຄອບຄົວອອກໄປຍ່າງຫຼິ້ນຢູ່ສວນສາທາລະນະ ເຫັນຄົນຈຳນວນຫຼາຍອອກກຳລັງກາຍແຄມທະເລສາບ ແລະເດັກນ້ອຍແລ່ນຫຼິ້ນ",
    "Russian": "Сегодня утром мы всей семьёй пошли гулять в парк и увидели на берегу озера много людей, которые занимались спортом.",
    "German": "Heute Morgen sind wir mit der ganzen Familie im Park spazieren gegangen und haben am See viele Leute beim Sport gesehen.",
}


@pytest.mark.parametrize("language", sorted(PROSE))
def test_prose_of_every_script_stays(spark, language):
    from pyspark.sql import functions as F

    line = PROSE[language]
    assert len(line) >= quality.HEADING_CHARS
    told = spark.createDataFrame([(line,), (line.rstrip("。।؟۔።.") + " ",)], "line string").select(quality.line_fails(F.col("line"))).collect()
    assert [r[0] for r in told][0] is False
    if language in ("Hindi", "Urdu", "German", "Amharic"):
        assert told[1][0] is True  # without its mark
