"""Sentence units: texts cut by hand, joined and cut again."""

import random
import re

import pytest

from pairloom.llm import problems
from pairloom.llm.sentences import sentences, units

#: Sentences of one text each; they are joined by a space (or nothing, in scripts without spaces).
SPACED = {
    "en": [
        "Near residue 453, the pocket of crisixin binds Dr. Orlinde's model.", "At pH 4.1, version 4.8.3 left 112 gaps of chain D.", "Compared with entry 8T0OJ0, M. G. Hartuvin et al. (540) saw nothing.",
        '"Is the mask real?" asked Dr. Dosvel during the open session.', "velsigen binds hinralase, see Sec. 6.5 for details (ref. 3).", 'The log reads: "Chain B was rebuilt. Nothing else changed."', "We thank Mr. Tavash Jr. for 486 plates.",
        "The map ... was closed, or so it seemed.", "“It is open,” wrote E. Velmoor, “and it stays so.”", "(The hinge was left out.)", "Wait... is it closed?!", "No. 7 of the series lacks it.", "It failed in vol. 1, pp. 533–537.", "The strand closes. [4]", "On 2 Jan. the group met.",
    ],
    "de": ["Am 5. Mai wurde klar, dass es z. B. bei 9,1 % liegt.", "Der Wert lag bei 1.152 Einheiten.", "„Ist die Kette echt?“, fragte Fr. Dr. Yorvanne.", "Im Protokoll steht: „Kette D fehlt. Sonst nichts.“", "Es bildet sich usw.", "Die 3. Probe war bzgl. tarnerin-7 leer.", "Es gilt, bevor die Tasche schließt (S. 936 f.).", "So vermuteten es S. Velmoor u. a. zuerst (vgl. Tab. 8)!"],
    "fr": ["La poche, p. ex. celle de 4EDAMR, atteint 4,34 Å !", "« La chaîne est-elle vraie ? » demanda le Dr Wexaldy.", "La note dit : « Chaîne H refaite. Rien d'autre. »", "Seuls 270 résidus sur 653 sont visibles, c.-à-d. sans gersinin…"],
    "es": ["«¿Es real la hélice?», preguntó el Sr. Quessary.", "La región, p. ej. la de 88AGLS, llega a 2,70 Å.", "Según la Dra. Yorvanne, es visible.", "¡La lámina no existe!"],
    "ru": ["«Настоящая ли это цепь?» — спросил г. Murvane.", "Они имеют общую часть, т. е. одна цепь меняет другую (см. табл. 4).", "По данным проф. Velmoor, маска доходит до 1,77 Å и т. д.", "В журнале написано: «Цепь F исправлена. Больше ничего.»"],
    "hi": ["डॉ. Wexaldy के अनुसार अनुक्रम छोटा रहता है।", "टिप्पणी कहती है: “शृंखला E बदली गई। और कुछ नहीं।”", "क्या crimidase-8 सच में जुड़ता है?"],
    "ar": ["«هل الواجهة حقيقية؟» سأل أ. Orlinde.", "بحسب د. Hartuvin، تصل البنية إلى دقة 4.14 Å.", "لماذا لا يرتبط modipin؟", "كتب في السجل: «أعيد بناء السلسلة. لا شيء آخر.»"],
    "th": ["ตามรายงานของ Orlinde มีเพียง 30 หน่วยที่มองเห็น", "ที่ค่า pH 8.9 พบว่าโพรงขนาดสั้น", "บันทึกระบุว่าเกลียวหายไป"],
}
CLOSE = {
    "zh": ["据Orlinde博士报告，分辨率为4.29 Å的链只含670个残基。", "“这个空腔是真的吗？”Brannike问道。", "记录写着：“A链已重建。其余未变。”", "（晶格已省略。）", "这与stocopin不同！？", "它保持开放的状态……"],
    "ja": ["「この格子は本物ですか？」とDosvelさんは尋ねた。", "記録には「E鎖を修正した。他は変更なし。」とある。", "3.12 Åの鎖には280残基しかない（表7）。", "なぜ結合しないのか？"],
}


@pytest.mark.parametrize("lang", [*SPACED, *CLOSE])
def test_p8_by_hand(lang):
    rng = random.Random(lang)
    own = SPACED.get(lang) or CLOSE[lang]
    for _ in range(40):
        picked = rng.sample(own, len(own))
        gaps = [("" if lang in CLOSE else rng.choice([" ", " ", "  "]) if lang == "th" else rng.choice([" ", "  ", "\n"])) for _ in picked]
        if rng.random() < 0.3:
            gaps[0] = rng.choice(["\n\n", "\r\n\r\n", "\n \t\n"])
        text = "".join(s + g for s, g in zip(picked, gaps))
        assert [text[a:b] for a, b in units(text)] == picked


def test_p8_headings_cuts_and_joins():
    def cut(text):
        return [text[a:b] for a, b in units(text)]

    assert cut("7. Results\n\nIt is so") == ["7. Results", "It is so"]
    assert cut("the end.The start of chain D.Compared") == ["the end.", "The start of chain D.", "Compared"]
    assert cut("it is visible.FOR CHAIN F. See Dr.Orlinde etc. (The rest was left out.)") == ["it is visible.", "FOR CHAIN F.", "See Dr.Orlinde etc.", "(The rest was left out.)"]
    assert cut('保持刚性的状态。"Is it real?" asked Dr. Dosvel.') == ["保持刚性的状态。", '"Is it real?" asked Dr. Dosvel.']
    assert cut('The log reads: "Chain B was rebuilt. Noth') == ['The log reads: "Chain B was rebuilt. Noth']
    assert cut("wrapped roughly\nhere. Next.") == ["wrapped roughly\nhere.", "Next."]
    assert cut("Unlike it, e.g. in D. voridula, the U.S.-style chain A. Both") == ["Unlike it, e.g. in D. voridula, the U.S.-style chain A.", "Both"]
    assert cut("It stops... and goes on… so. Then... It") == ["It stops... and goes on… so.", "Then...", "It"]


def test_p8_covers_all_but_white_space(spark, sf):
    texts = [r["text"] for r in problems.table(spark, sf, "documents").collect() if r["text"]]
    rng = random.Random(0)
    texts += ["".join(rng.choices(".!?…。「」“”\"«»()[]1aA漢ก \n\t'", k=rng.randint(0, 80))) for _ in range(3000)]
    for t in texts:
        own = units(t)
        assert re.sub(r"\s", "", "".join(t[a:b] for a, b in own)) == re.sub(r"\s", "", t)
        assert all(b <= c for (_, b), (c, _) in zip(own, own[1:])) and all(t[a:b].strip() == t[a:b] and a < b for a, b in own)


def test_p8_edges(spark):
    df = spark.createDataFrame([(1, "So it. It is", 0), (1, "So it. It is", 0), (2, None, 0), (3, "", 0), (4, " \n ", 0), (None, "x", 0), (5, "😀 x. B", 0)], "doc_id long, text string, start_pos int")
    got = sorted((r["doc_id"] or 0, r["start_pos"], r["end_pos"]) for r in sentences(df, "doc_id", "text").collect())
    assert got == [(0, 0, 1), (1, 0, 6), (1, 0, 6), (1, 7, 12), (1, 7, 12), (5, 0, 4), (5, 5, 6)]
    assert sentences(df.limit(0), "doc_id", "text").count() == 0
    long = "It is so. " * 50_000
    assert len(units(long)) == 50_000
    assert len(units('"' + long)) >= 1 and len(units("x" * 1_000_000)) == 1
