import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import sentences as S

CASES = {
    "abbreviations": ["One ledger etc. marks the row e.g. under No. 17 cf. Fig. 3.", "Our filter ends etc.", "Another row follows at v1.9.2 in cache.rs for 1,204.5 ms."],
    "quotes": ["A row marks \"each table ends the day?\" – before a task.", "\"Each row is a day.\"", "(This one stands alone.)", "That row (vs.) ends the span."],
    "ellipsis": ["It waits … for some rows.", "It ends here...", "Then it goes on (…) again?!", "drops_shard() ends."],
    "german": ["Die Datei löscht z. B. die Funktion d. h. das Feld usw.", "Die Probe liest bzw. Nr. 12 die Tabelle (vgl. Abschn. 4.2) um das Raster."],
    "german quotes": ["Das Feld „die Pause schreibt das Budget!“ – prüft die Quelle.", "„Die Probe endet.“", "32 die Funktion zählt die Stufe."],
    "russian": ["Ключ делит и т. д. предел т. е. напр. см. рис. 5 за адрес.", "«Знак ограничивает стр. 18 сервер.»", "63 старый отчёт идёт и т. п.", "Другой знак."],
    "spanish": ["El bloque borra p. ej. el enlace con EE. UU. bajo la red núm. 9 aprox. 3,2 veces.", "¿Quién lo guarda?", "Nadie."],
    "hindi": ["शाखा नियम को पढ़ता है सं. 9.6।", "खाली माप को बदलता है?", "नया नियम।"],
}
EAST = {
    "zh": ["一旦边界统计字段，模型写入注释。", "「如果仓库描述日志。」他们这样说，因为缓存加载样本！", "只要缓存比较集合……然后响应检查批次（约58.9）。", "v7.9.6版本重建队列？"],
    "ja": ["古い修正は報告を絞る。", "「完全な標本が読み直す。」と書いてあり、通知を書き出す！", "経路が隠れる……そして閾値を数える。"],
}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("gap", [" ", "  ", "\n", "\n\n"])
def test_spaced(name, gap):
    text = gap.join(CASES[name])
    assert [text[a:b] for a, b in S.sentence_spans(text)] == CASES[name]


@pytest.mark.parametrize("name", sorted(EAST))
@pytest.mark.parametrize("gap", ["", "\n", "\n\n"])
def test_spaceless(name, gap):
    text = gap.join(EAST[name])
    assert [text[a:b] for a, b in S.sentence_spans(text)] == EAST[name]


def cut(text):
    return [text[a:b] for a, b in S.sentence_spans(text)]


def test_thai():
    assert cut("ไฟล์เก็บคิว ตารางอ่านกฎ v7.6 จึงลบ\nแคชอ่าน") == ["ไฟล์เก็บคิว", "ตารางอ่านกฎ v7.6 จึงลบ", "แคชอ่าน"]


def test_blocks():
    text = ("# A heading. With a stop\n\n=== Other heading\n\n- one entry. It is one\n* two\n1. three!\n2. four\n\n> quoted text that\n> goes on. And ends.\n\n```\ncode. More. \n\nx\n```\n"
            "// a comment over\n// two lines. Another one.\n\n * starred\n * comment. Done\n\n| piped prose\n| ends.\n-- dashed. text here.\n\n---\nlast (No.\n17) line.")
    assert cut(text) == ["A heading. With a stop", "Other heading", "one entry. It is one", "two", "three!", "four", "quoted text that\n> goes on.", "And ends.", "```\ncode. More. \n\nx\n```",
                         "a comment over\n// two lines.", "Another one.", "starred\n * comment.", "Done", "piped prose\n| ends.", "dashed.", "text here.", "last (No.\n17) line."]


def test_lower_case_and_wrapping():
    assert cut("# der rest der\n# datei endet. das feld\n# auch.") == ["der rest der\n# datei endet.", "das feld\n# auch."]
    assert cut("Unclosed fence\n\n~~~\na. B. c") == ["Unclosed fence", "~~~\na. B. c"]
    assert cut("Windows\r\nline one. Two.\r\n") == ["Windows\r\nline one.", "Two."]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab AB.!?…。「」『』()\"“”„«»'\n#>-*1|/`あ漢ก।é,;:", max_size=120))
def test_spans_are_in_order_and_trimmed(text):
    at = 0
    for a, b in S.sentence_spans(text):
        assert at <= a < b <= len(text) and text[a:b] == text[a:b].strip()
        at = b


def test_table(spark):
    long = "Each row ends here. " * 20_000
    d = spark.createDataFrame([(1, "One. Two.", 0), (1, "One. Two.", 0), (2, None, 0), (None, "x.", 0), (3, "", 0), (4, " \n ", 0), (5, long, 0)], "doc_id long, text string, start_char int").coalesce(1)
    rows = S.sentences(d.dropDuplicates()).collect()
    assert sorted((r[1], r[2]) for r in rows if r[0] == 1) == [(0, 4), (5, 9)] and {r[0] for r in rows} == {1, 5} and sum(r[0] == 5 for r in rows) == 20_000
    assert S.sentences(d.limit(0)).collect() == []


def test_repeated_rows_give_their_sentences_once(spark):
    d = spark.createDataFrame([(1, "One. Two."), (1, "One. Two."), (2, "One.")], "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, S.sentences(d).collect())) == [(1, 0, 4), (1, 5, 9), (2, 0, 4)]


def test_gaps_without_marks_follow_particles_and_openers():
    assert cut("今天很好我们走吧他来了然后我们去公园") == ["今天很好我们走吧", "他来了", "然后我们去公园"]
    assert cut("昨日は雨でしたしかし今日は晴れです私は行きます") == ["昨日は雨でした", "しかし今日は晴れです", "私は行きます"]
    assert cut("稀疏的令牌与令牌") == ["稀疏的令牌与令牌"]


def test_dictionary_covers_the_whole_clause():
    known = S.dictionary()
    assert known.size > 2_500
    assert known.words("今天很好我们走吧他来了然后我们去公园")[:4] == ["今天", "很好", "我们", "走吧"]
    assert "".join(known.words("龘龘我们龘")) == "龘龘我们龘" and known.words("") == []


@pytest.mark.parametrize("text, count", [
    ('He said "yes." ' * 70_000, 70_000), ("(A. " * 20_000 + ")" * 20_000, 1), ("(" * 50_000 + '"a." ' * 5_000, 1), ("." * 200_000 + "x", 1), (">// " * 3_000 + "x", 1),
    ("He (A. B. " + "C. D. " * 50_000 + "). End.", 2), ("我们走……" * 20_000 + "吧。", 1)])
def test_long_paragraphs_take_time_in_proportion(text, count):
    began = time.process_time()
    assert len(S.sentence_spans(text)) == count
    assert time.process_time() - began < 10
