"""Round trips: texts garbled in every known way are found and come back; proper texts are left alone."""

import pytest
from pyspark.sql import functions as F

from framewright.llm import mojibake as M

WEST = "L'élève a préféré le café déjà là, où l'hôtesse répète. Die Küchenhilfe öffnete größere Türen. El niño olvidó el jabón."
RUSSIAN = "Скажите, где номер заказа возле рынка? Водитель перенёс тихую комнату прошлой осенью."
JAPANESE = "二人目の話者は五番ホームでバスの時刻を確認しました。すみません、会議室の鍵はどこですか。"


def read(text, as_, meant="utf-8"):
    out = []
    for b in text.encode(meant):
        try:
            out.append(bytes([b]).decode(as_))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("text", [WEST, RUSSIAN, "“Hi” — it’s 3 × 5 mm, £7 or €8… ½ º"])
@pytest.mark.parametrize("as_", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
def test_utf8_read_as(text, as_):
    got = M.repair(read(text, as_))
    assert got.garbled and got.restored and got.text == text


@pytest.mark.parametrize("as_", ["cp1252", "latin-1"])
def test_nested(as_):
    assert M.repair(read(read(WEST, as_), as_)).text == WEST
    assert M.repair(read(JAPANESE, as_)).text == JAPANESE


@pytest.mark.parametrize("meant", ["cp1251", "koi8_r"])
def test_cyrillic_as_latin(meant):
    assert M.repair(read(RUSSIAN, "cp1252", meant)).text == RUSSIAN


PAGES = [("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8_r", "cp866"), ("cp866", "koi8_r"), ("iso8859_5", "cp1251"), ("iso8859_5", "koi8_r")]


@pytest.mark.parametrize(("meant", "as_"), PAGES)
def test_cyrillic_as_cyrillic(meant, as_):
    got = M.repair(read(RUSSIAN, as_, meant))
    assert got.restored and got.text == RUSSIAN


@pytest.mark.parametrize(("meant", "as_"), PAGES)
def test_cyrillic_as_cyrillic_in_part(meant, as_):
    garbled = f"Кассир услышал первую фразу. {read(RUSSIAN, as_, meant)} Мой брат забыл синий билет, “ВСЁ”."
    got = M.repair(garbled)
    assert got.restored and got.text == f"Кассир услышал первую фразу. {RUSSIAN} Мой брат забыл синий билет, “ВСЁ”."


def test_cyrillic_damage_that_begins_inside_a_word():
    assert M.repair("Сначала расРЙУБОЙЕ ОБ РСФПК РМБФЖПТНЕ").text == "Сначала расписание на пятой платформе"


@pytest.mark.parametrize("text", ["ДИКТОР СКАЗАЛ: ПОВТОРИТЕ, ПОЖАЛУЙСТА, АДРЕС КОНТОРЫ", "СССР, США, ЦРУ, МВД, ГУЛАГ и ВЛКСМ", "УКРАЇНА — Її ґанок, Європа", "ЉУБАВ И ЊЕГОВА ЋЕРКА, ђак", "БЪЛГАРИЯ: ЩЪРКЕЛ НА ПЪТЯ", "iPhone для МамыИПапы, ЖКХ № 5"])
def test_proper_cyrillic(text):
    assert not M.repair(text).garbled


def test_japanese_as_latin():
    assert M.repair(read(JAPANESE, "cp1252", "cp932")).text == JAPANESE


@pytest.mark.parametrize("meant", ["cp437", "cp850"])
def test_western_as_western(meant):
    text = "la première phrase répétée, el jabón del niño, die Küche"
    assert M.repair(read(text, "cp1252", meant)).text == text


@pytest.mark.parametrize(
    ("garbled", "text"),
    [
        ("le collŠgue a r‚p‚t‚ ‡a, puis mon frère a demandé l'adresse complète à côté", "le collègue a répété ça, puis mon frère a demandé l'adresse complète à côté"),
        ("Mon frère a demandé ça. L'h“tesse a r‚p‚t‚ la premiŠre phrase. Où est la clé à côté?", "Mon frère a demandé ça. L'hôtesse a répété la première phrase. Où est la clé à côté?"),
        ("It’s the naïve one, isn’t it… “Se¤or” was heard — señor", "It’s the naïve one, isn’t it… “Señor” was heard — señor"),
        ("met at the caf‚; the librarian waits…", "met at the café; the librarian waits…"),
        ("“Señor” was heard. Gain ±5 µV, ½ scale… Met at the caf‚.", "“Señor” was heard. Gain ±5 µV, ½ scale… Met at the café."),
        ("repiti¢ una vez", "repitió una vez"), ("cafÚ, cafÚ", "café, café"), ("in die B\x81cherei", "in die Bücherei"), ("Speaker \x9dye (4983 õ) read", "Speaker Øye (4983 §) read"),
        ("Speaker Øye (64 §) spoke. Speaker \x9dye (53 õ) read", "Speaker Øye (64 §) spoke. Speaker Øye (53 §) read"), ("in den gr”áeren Tisch", "in den größeren Tisch"),
    ],
)
def test_western_in_part_and_at_edges(garbled, text):
    got = M.repair(garbled)
    assert got.garbled and got.restored and got.text == text


@pytest.mark.parametrize("text", ["‚so‘ sagte Zoë, „gut“ — l’été “là”…", "hola! ¿qué™ µV°", "TÉLÉ ÉCOLE iPod™ café™ R²", "El niño™ pagó 5¢, 5 £ o 3 ¤", "5 kΩ und 3 MΩ, sin α"])
def test_proper_signs_at_edges(text):
    assert not M.repair(text).garbled


def test_part_of_a_text():
    text = f"{JAPANESE} proper. {read(WEST, 'cp1252')} “proper” again"
    assert M.repair(text).text == f"{JAPANESE} proper. {WEST} “proper” again"


def test_changed_case_after_the_damage():
    assert M.repair(read("El jabón del niño, café", "cp1252").lower()).garbled
    assert M.repair(read("el jabón — “sí”", "cp1252").upper()).garbled


def test_lost_for_good():
    got = M.repair("c�t� du caf�")
    assert got.garbled and not got.restored


@pytest.mark.parametrize(
    "text",
    [
        WEST, RUSSIAN, JAPANESE, "", None, "plain", WEST.upper(), RUSSIAN.upper(), "Ð, Ñ, Â, Ã, ‚ and ƒ are keys in row 7.", "Zażółć gęślą jaźń — próba.", "VICENTE É O PORTO Nº 401.", "It is 3 × 571 mm – déjà vu.",
        "Speaker Øye (3451 §) — ±5 µV, ½ scale…", "Þórður á Ísafirði", "👩‍🔧 😀👍🏽", "a\x85b\x07c\x80", "El señor Ibáñez dijo: “la dirección”. ¿Sí?", "cœur, œuvre, Œdipe", "Γειά σου", "Škoda für 3\xa0€", "«СССР» — ВСЁ", "prix : 5 € l’été « là »", "naïve Zoë’s résumé",
    ],
)
def test_proper_texts(text):
    assert not M.repair(text).garbled


SCRIPTS = {
    "ko": "한국어 텍스트가 깨졌습니다", "ar": "مرحبا بالعالم هذا نص عربي", "hi": "नमस्ते दुनिया यह हिंदी है", "th": "สวัสดีชาวโลก", "he": "שלום עולם זה טקסט בעברית",
    "el": "Καλημέρα κόσμε, αυτό είναι ελληνικό κείμενο", "vi": "Tiếng Việt rất đẹp và khó đọc", "zh": "我们今天去学校学习中文这是一个很好的机会",
}


@pytest.mark.parametrize("lang", SCRIPTS)
def test_other_scripts(lang):
    text = SCRIPTS[lang]
    assert not M.repair(text).garbled
    got = M.repair(read(text, "cp1252"))
    assert got.restored and got.text == text


@pytest.mark.parametrize(("lang", "meant"), [("el", "cp1253"), ("el", "iso8859_7"), ("he", "cp1255"), ("ar", "cp1256"), ("ko", "cp949"), ("zh", "gbk")])
def test_other_encodings_as_latin(lang, meant):
    got = M.repair(read(SCRIPTS[lang], "cp1252", meant))
    assert got.garbled and got.restored and got.text == SCRIPTS[lang]


@pytest.mark.parametrize("as_", ["cp1254", "cp852", "koi8_u", "cp861"])
def test_rare_code_pages(as_):
    assert M.repair(read(RUSSIAN, as_)).text == RUSSIAN


@pytest.mark.parametrize("layers", [1, 6, 7, 11])
def test_any_number_of_layers(layers):
    text = "café déjà"
    for _ in range(layers):
        text = read(text, "cp1252")
    got = M.repair(text)
    assert got.restored and got.text == "café déjà"


@pytest.mark.parametrize(("garbled", "text"), [("lead paid œ1666 for it", "lead paid £1666 for it"), ("it was 9339 øC behind", "it was 9339 °C behind"), ("the annotator ú 2253", "the annotator · 2253"), ("prueba n§ 12", "prueba nº 12")])
def test_lone_signs(garbled, text):
    assert M.repair(garbled).text == text


@pytest.mark.parametrize("text", ["demain l’élève a reporté, l’été, l’église, l’écran, l’époque", "L’œuvre no 7, øre, œ", "§ 5 und Nr. 7 · 8", "Ça va, cœur, ø"])
def test_signs_that_are_proper(text):
    assert not M.repair(text).garbled


def test_half_repaired_is_not_restored():
    got = M.repair(f"{read(JAPANESE, 'cp1252', 'cp932')} \x81 ЊЊЃ \x8d")
    assert got.garbled and not got.restored


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, read("café", "cp1252"), "x"), (3, read("café", "cp1252"), "x"), (4, "caf�", None), (5, "ok é", "x"), (6, read("é " * 40000, "cp437"), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, garbled string")
    got = M.repair_texts(df).select("doc_id", "garbled", "restored", "restored_text", F.size("layers").alias("n")).collect()
    assert sorted((r.doc_id, r.garbled, r.restored) for r in got) == [(1, False, False), (2, False, False), (3, True, True), (3, True, True), (4, True, False), (5, False, False), (6, True, True)]
    assert {r.restored_text for r in got if r.doc_id == 3} == {"café"} and {r.restored_text for r in got if r.doc_id in (1, 2)} == {None, ""}
    assert M.repair_texts(df.where("false")).count() == 0
