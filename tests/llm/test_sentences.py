import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm.sentences import sentence_spans, sentences

# Sentences are divided by "|"; the bar itself stands for the white space there, or for none.
CASES = [
    ["The President:", "\n\n", "(Hear, hear!)", " ", "Mr. J. R. Smith of St. Vell wrote on 3 Oct. 2009 about No. 7, p. 4."],
    ["The vote was taken at 4 p.m. on Tuesday.", " ", "It resumed at 2 p.m.", " ", "On that point, the levy covers oats, rye, etc.", " ", "We agree."],
    ["Her words were: “barriers must wait.”", " ", "Mr. Ond said, “Enough! Who pays?” and sat down.", " ", "“We will not wait,” said Ms. A, “not yet.”"],
    ["We waited ... and waited ... for it.", " ", "So much for tolls…", " ", "The end is at a.example/v1.2 for all."],
    ["It dropped it — order! — as agreed.", " ", "— Order! —", " ", "Is it 4.5 or 7.2 per cent?!", " ", "The ship U.S.V. Merrow left at 06.45 hrs.", " ", "Thanks."],
    ["I agree (yes or no?) that it stands (hear, hear!).", " ", "Point 67(b) was carried, 1,336 to 22.", " ", "Leave was granted."],
    ["I declare the sitting open.", "", "Our region agrees!", "", "Let it be."],
    ["Am 3. Oktober 2004 behandelte der 14. Ausschuss z. B. Moorschutz, d. h. mehr, nach § 1 Abs. 59.", " ", "Die Sache kostet 22.509 Kronen, S. 45 ff., usw.", " ", "Gut."],
    ["Frau A rief: „Genug! Wer zahlt das?“ und setzte sich.", " ", "Ich sage nur: „Moorschutz zuerst!“", " ", "Der Minister – Beifall! – ändert es.", " ", "(Unruhe. Widerspruch.)", " ", "So weit …", " ", "Der Rest."],
    ["« Nous n’attendrons pas », a dit Mme Q, « pas un jour ».", " ", "C’est faux !", " ", "M. A cite l’art. 62, al. 61, du 1er oct. 2018.", " ", "Il salue – protestations ! – le texte."],
    ["La Sra. O gritó: «¡Basta! ¿Quién paga?» y se sentó.", " ", "¡Eso es falso!", " ", "Afecta p. ej. a la cebada, la enmienda núm. 42.", " ", "Muchas gracias."],
    ["Ο κ. Ορμίνης είπε: «Ως εδώ! Ποιος πληρώνει;» και κάθισε.", " ", "Ποιος διαφωνεί;", " ", "Βλ. αρ. 10, σελ. 46· για αυτό."],
    ["蔵峰：", "\n\n", "費用は23.7％増えました。", "", "蔵峰君は「もう十分だ。誰が払うのか。」と述べました。", "", "一言は、「先だ！」", "", "1.71億の渡し船は……見送られました。", "", "（拍手）", "", "資料No.13です。"],
    ["祁渡说：“够了！谁来付钱？”然后坐下。", "", "这令人遗憾……", "", "只有一句话：“优先！”", "", "请看第9号文件第1.2节。", "", "委员会（插话：对！）支持。", "", "对吗？！", "", "对。"],
    ["सन् 1990 ई. में डॉ. तिमाकर ने कहा।", " ", "श्री तिमाकर बोले, “बस! कौन देगा?” और बैठ गए।", " ", "यह गलत है!", " ", "(तालियाँ।)", " ", "सभा।"],
    ["قال د. فيلوران: «كفى! من يدفع؟» ثم جلس.", " ", "هذا غير صحيح!", " ", "من يجيب؟", " ", "ہماری جماعت (تالیاں) نے مان لیا۔", " ", "(شور)", " ", "یہ غلط ہے!"],
    ["ใครจะตอบเรื่องอาหารครับ", " ", "เรื่องอาหารกับค่าผ่าน รัฐมนตรี (เสียงปรบมือ) พิจารณาแล้วหรือยังคะ", " ", "(เสียงหัวเราะ)", " ", "เพิ่มขึ้น 31.5 เปอร์เซ็นต์ค่ะ"],
    ["A line\nbroken by hand stays one.", " \n \n", "Heading without a stop", "\r\n\r\n", "So be it."],
]


@pytest.mark.parametrize("parts", CASES, ids=range(len(CASES)))
def test_scripts_and_traps(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentence_spans(text)] == parts[::2]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB. !?…。「」()“”—\n\r\t;ค่ะ9'\"，", max_size=60))
def test_units_cover_all_but_white_space(text):
    last = 0
    for a, b in sentence_spans(text):
        assert last <= a < b and not text[a].isspace() and not text[b - 1].isspace() and not text[last:a].strip()
        last = b
    assert not text[last:].strip()


def units(text):
    return [text[a:b] for a, b in sentence_spans(text)]


def test_defined_results(spark):
    long = "This goes on. " * 20_000
    rows = [(1, "One. Two.", 0), (1, "One. Two.", 0), (2, None, 0), (3, "", 0), (4, " \n\t", 0), (5, long, 0), (6, "😀 Yes. No.", 0)]
    got = sentences(spark.createDataFrame(rows, "doc_id long, text string, start_char int")).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] != 5) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (6, 0, 6), (6, 7, 10)]
    assert sum(r["doc_id"] == 5 for r in got) == 20_000
    assert sentences(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_list_levels():
    assert units("Items:\n1. First item here. It is good.\n2. Second item.") == ["Items:", "1. First item here.", "It is good.", "2. Second item."]
    assert units("1. One.\n(a) first sub\n(b) second\n2. Two.\n3. Three") == ["1. One.", "(a) first sub", "(b) second", "2. Two.", "3. Three"]
    assert units("We need:\n- apples\n- plums") == ["We need:", "- apples", "- plums"]
    assert units("Das steht in Abs.\n1. Danach kommt mehr.") == units("Das steht in Abs. 1. Danach kommt mehr.".replace("Abs. ", "Abs.\n"))
    assert len(units("He read page\n12. It was long.")) == 2


def test_no_cap_on_interruptions_and_markers():
    long = "x" * 200
    assert len(units(f"He left. — That {long} is wrong! — He came back.")) == 3
    assert units("(1234567890) is a marker") == ["(1234567890) is a marker"]


def test_time_grows_with_the_text():
    import time

    def took(text):
        began = time.perf_counter()
        sentence_spans(text)
        return time.perf_counter() - began

    for make in (lambda n: "“a. " * n, lambda n: "«“a. " * n + "b.” »" * n, lambda n: ")" * n + "(“" * n, lambda n: "a.b." * n, lambda n: "— a " * n, lambda n: "\n1. a" * n):
        took(make(500))
        assert took(make(16_000)) < 16 * max(took(make(2_000)), 0.004)
