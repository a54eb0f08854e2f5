"""Text rules as language packs: patterns and word lists are parameters, the Chinese pack is the default.

Patterns are Java regular expressions. (?U) makes classes Unicode-aware, (?d) keeps line ends to \\n, (?s) lets a dot
cross lines, (?m) anchors at lines.
"""

from __future__ import annotations

from dataclasses import dataclass

# fixed values: chapter marker lines, after trimming
CHAPTER_MARKERS = (
    r"^第[一二三四五六七八九十百千\d]+部[^第]*第[一二三四五六七八九十百千\d]+章([\s　]+.+)?$",
    r"^第[一二三四五六七八九十百千]+[章节回卷]([\s　]+.+)?$",
    r"^第\d+[章节回卷]([\s　]+.+)?$",
    r"^Chapter\s*\d+([\s　]+.+)?$",
)
#: The same with the numerals for zero and two that the above lack.
CHAPTER_MARKERS_EXTENDED = tuple(p.replace("一二三四五六七八九十百千", "零〇一二两三四五六七八九十百千") for p in CHAPTER_MARKERS)

# fixed values: section titles, separators, defaults
UNKNOWN_SECTION, KNOWN_SECTION = "未知信息", "已知信息"
INITIAL_EMOTION, DEFAULT_RELATION, DEFAULT_TRUST = "初始状态", "相关", "中"
NO_EXAMPLES = "暂无"


@dataclass(frozen=True)
class Pack:
    """Patterns of one language; each is searched for anywhere unless anchored."""

    # fixed values: signs of an answer out of role
    self_disclosure: str = r"(?iU)(作为(一个)?(AI|人工智能|语言模型)|我(只是|是)(一个)?(AI|人工智能|语言模型))"
    refusal: str = r"(?U)^(抱歉|对不起|很抱歉)[，。！\s]*(我无法|我不能|作为|这是一个)"
    closing_phrase: str = r"(?Ud)(需要我(帮忙|做些什么)吗|随时提问|很高兴为(您|你)解答|如果(您|你)有任何问题|我乐意效劳)[。？！\?!\s]*$"
    disclaimer: str = r"(请注意[，。]这只是|我无法(为(您|你))?提供|这超出了我的(能力|知识)范围|(无法|不便|不能)(透露|提供|回答|说明)(具体)?(细节|信息|内容|答案|情况)?)"
    third_person: str = r"[他她][^们]{0,4}(说|感到|觉得|认为|想|看|做|走|回答|表示)"
    numbered_bold: str = r"(?Umd)^\s*\d+\.\s+\*\*"
    native_script: str = r"[一-龥]"
    first_person: str = "我"
    narration_over: int = 30
    # fixed values: signs of a bad question or answer
    ellipses: tuple[str, ...] = ("...", "……")
    stage_direction: str = r"(?U)^\s*[（(][^）)]{1,30}[）)]"
    rhetorical_opening: str = r"(?U)^\s*[^。！？!?\n]{1,14}[？?]\s*"
    as_model: str = r"(?d)(作为|身为).{0,4}(AI|语言模型)"
    not_but: str = r"(?d)不是.{1,20}而是"
    closing_question: str = r"(?Ud)(不是吗|难道.{0,10}[？?]|你说呢\s*[？?]|对吗\s*[？?]|不对吗\s*[？?]|你明白吗\s*[？?])\s*$"
    autobiography: tuple[str, ...] = (
        r"(?d)从.{0,4}(岁|年|小时候|童年).{0,10}(开始|起)",
        r"(?d)(父亲|母亲|爸爸|妈妈|家人|祖父|外婆).{0,10}(给我|教我|带我|告诉我)",
        r"(?d)(小时候|童年时?|年幼时?).{0,20}(记得|记忆|印象)",
    )
    personal_words: tuple[str, ...] = ("父亲", "母亲", "童年", "小时候", "家人", "岁时", "年幼", "幼年")
    second_person: tuple[str, ...] = ("你", "您")
    title_words: str = r"(老师|教授|将军|博士|警官|先生|女士|同学)$"
    asked_of_others: str = r"(认为|会不会|会|打算|说|觉得|是否|能不能|有没有|为什么|怎么|是不是|有没有)"
    yes: str = "是"
    no: str = "否"
    # fixed values: speech attribution
    speech_verbs: str = r"(?:说|说道|道|问|回答|答道|答|喊|叫|笑|骂|吼|低声说|反问|解释|补充)"
    name_run: str = r"[一-龥·]{2,6}"
    quote_open: str = "“"
    quote_close: str = "”"
    # fixed values: cleaning
    gesture: str = r"(?U)^(我|他|她)??(轻轻摇头|摇了摇头|沉默了一会儿|皱了皱眉|苦笑了一下|叹了口气)[，,。]\s*"


ZH = Pack()

# fixed values: kinds of questions, in order
INTENTS = ("事实追问", "情绪追问", "关系追问", "观点追问", "行动追问", "日常闲聊", "打招呼问候", "情绪陪伴")

#: What each kind asks for, in our own words, in the same order.
INTENT_SCOPE = ("查证经历和知道的事", "问当下的感受", "问与他人的关系", "问看法和判断", "问打算和做法", "闲谈日常", "打招呼、问近况", "安慰与陪伴")
