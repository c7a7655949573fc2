"""Limits and character sets, with a Chinese default and a Latin profile.

Operators take a :class:`SubtitleParams`; nothing is read from global state.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# -- Fixed values: character sets and word lists of the Chinese profile ---------

CJK_CLASS = "[一-鿿]"
CLAUSE_MARKS = "，。！？、；："
SPLIT_MARKS = "。！？；，、"
SENTENCE_END = "。！？.!?"
ALREADY_PUNCTUATED = "。！？；：，、,.!?;:"
DISPLAY_PUNCTUATION = "，。！？；：、\"\"''（）【】《》—…·,.'!?;:()[]{}<>-–"
LINE_START_FORBIDDEN = "的了着过吗呢吧啊呀哇嘛呗啦咯嗯噢哦哈"
LINE_END_FORBIDDEN = "不没很更最就才又再还却倒并而或"
FRAGMENT_STARTERS = "的了着过吗呢吧啊呀哇嘛呗啦咯嗯噢哦哈但是因为所以如果虽然然后不过"
BACKWARD_ENDINGS = "啊呀哇嘛呗啦咯嗯噢哦哈对呢吧吗"
QUESTION_ENDINGS = (
    "吗", "呢", "吧", "什么", "怎么", "为什么", "哪里", "谁",
    "多少", "几", "是否", "难道", "究竟", "到底", "如何",
)
EXCLAMATION_ENDINGS = ("太", "好", "真", "特别", "非常", "极其", "超级", "真的", "啊", "呀", "哇", "哎")
CONNECTIVES = (
    "但是", "不过", "可是", "其实", "然后", "所以", "而且", "就是",
    "因为", "如果", "虽然", "因此", "或者", "同时", "另外", "那么",
    "对", "嗯", "啊", "是", "不是", "那个", "这个",
    "所以说", "也就是说", "换句话说", "总而言之",
)
COMMA_CONNECTIVES = (
    "但是", "不过", "可是", "虽然", "如果", "所以", "因此", "那么",
    "对", "嗯", "啊", "是", "不是", "而且", "同时", "另外", "或者",
)
INTERRUPTION_OPENERS = (
    "但是", "不过", "可是", "其实", "然后", "所以", "而且", "就是", "对", "嗯", "啊", "不是", "你",
)
FILLER_PATTERNS = (
    "那个那个", "这个这个", "然后然后", "就是就是", "嗯嗯嗯+", "啊啊啊+", "呃呃呃+",
)
COMMON_ENGLISH = (
    "the", "and", "for", "not", "but", "all", "can", "her", "him", "one", "our", "out", "has",
    "have", "had", "was", "are", "been", "from", "this", "that", "with", "they", "will", "what",
    "when", "who", "how", "why", "did", "get", "got",
)
STOP_WORDS = (
    "的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一",
    "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有",
    "看", "好", "自己", "这", "他", "她", "它", "那", "这个", "那个", "什么",
    "怎么", "为什么", "因为", "所以", "但是", "然后", "如果", "就是", "其实",
    "对", "吧", "啊", "嗯", "哦", "嘛", "呢", "哈", "呀", "哎", "唉",
)
ZHU_COMPOUNDS = (
    "著名", "著作", "著称", "著录", "著者", "著书",
    "专著", "论著", "译著", "原著", "合著", "遗著",
    "显著", "昭著", "卓著", "名著",
)
WORD_CHECKS = (
    (r"(.)\1{2,}", "repeat_stutter"),
    ("[一-鿿][啊呃嗯唔哦噢哈呀哇嘛呗]", "filler_sound"),
    ("什么[教叫要是]", "asr_confusion"),
)
RULE_CATEGORIES = ("authors", "works", "idioms", "common", "variants", "asr_phonetic", "asr_noise")


@dataclass(frozen=True)
class SubtitleParams:
    """Limits of the subtitle checks and merges. Times are seconds."""

    min_display_s: float = 1.0
    max_display_s: float = 7.0
    min_gap_s: float = 0.067
    reading_speed: float = 4.0
    max_chars: int = 18
    max_lines: int = 1
    count_class: str = CJK_CLASS
    clause_marks: str = CLAUSE_MARKS
    split_marks: str = SPLIT_MARKS
    sentence_end: str = SENTENCE_END
    line_start_forbidden: str = LINE_START_FORBIDDEN
    line_end_forbidden: str = LINE_END_FORBIDDEN
    fragment_starters: str = FRAGMENT_STARTERS
    backward_endings: str = BACKWARD_ENDINGS
    openers: tuple[str, ...] = INTERRUPTION_OPENERS
    fillers: tuple[str, ...] = FILLER_PATTERNS
    common_words: tuple[str, ...] = COMMON_ENGLISH
    word_checks: tuple[tuple[str, str], ...] = WORD_CHECKS
    question_endings: tuple[str, ...] = QUESTION_ENDINGS
    exclamation_endings: tuple[str, ...] = EXCLAMATION_ENDINGS
    comma_connectives: tuple[str, ...] = COMMA_CONNECTIVES
    connectives: tuple[str, ...] = CONNECTIVES

    @property
    def max_speed(self) -> float:
        return self.reading_speed * 1.5

    @property
    def min_display_ms(self) -> int:
        return int(self.min_display_s * 1000)

    @property
    def max_display_ms(self) -> int:
        return int(self.max_display_s * 1000)

    @property
    def min_gap_ms(self) -> int:
        return int(self.min_gap_s * 1000)

    @property
    def capacity(self) -> int:
        return self.max_chars * self.max_lines

    def with_values(self, **changes) -> "SubtitleParams":
        """A copy with some values changed; an unknown name is an error."""
        known = {f.name for f in fields(self)}
        unknown = sorted(set(changes) - known)
        if unknown:
            raise KeyError(f"unknown parameters: {unknown}")
        return replace(self, **changes)


PUBLISHING = SubtitleParams(max_chars=15, max_lines=2)
"""Limits of the publishing standard: 15 characters on two lines."""

LATIN = SubtitleParams(
    reading_speed=18.0,
    max_chars=42,
    count_class="[A-Za-z]",
    clause_marks=",.!?;:",
    split_marks=".!?;,",
    line_start_forbidden="eaoE",
    line_end_forbidden="nts",
    fragment_starters="eaoE",
    backward_endings="ehn",
    openers=("On", "En", "La", "The", "Die"),
    fillers=("enen", "thth", "eree+"),
    question_endings=("en", "er", "qui"),
    exclamation_endings=("on", "st"),
    comma_connectives=("Le", "In", "Das"),
    connectives=("Les", "Le", "In", "Das", "De"),
    word_checks=((r"(.)\1{2,}", "repeat_stutter"), ("[a-z]er", "filler_sound"), ("th[aeo]", "asr_confusion")),
)
"""Profile for text in Latin script: 42 letters a line, 18 letters a second."""

LATIN_PUBLISHING = replace(LATIN, max_lines=2)


@dataclass(frozen=True)
class TopicParams:
    min_topic_s: float = 60.0
    max_topic_s: float = 600.0
    silence_s: float = 1.5
    word_pattern: str = "[一-鿿]{2,6}"
    stop_words: tuple[str, ...] = STOP_WORDS
    top_words: int = 10
    kept_words: int = 5
    untitled: str = "未命名主题"
    other: str = "其他"
    theme_separator: str = "、"
    opening_category: str = "golden_quote"
    ending_category: str = "summary"
    min_clips: int = 2
    max_clips: int = 5


@dataclass(frozen=True)
class AudioParams:
    target_lufs: float = -14.0
    max_true_peak: float = -1.0
    max_lra: float = 10.0
    silence_db: float = -40.0
    breath_db: float = -30.0
    min_breath_s: float = 0.15
    max_breath_s: float = 0.8
    min_silence_s: float = 0.3
    search_s: float = 1.0
    padding_s: float = 0.1
    frame_ms: int = 100
