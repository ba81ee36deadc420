"""Text predicates and formats as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark a caption as a model's refusal, for three uses.
PREVIEW_REFUSALS = (
    "sorry", "cannot browse", "can't browse", "unable to browse", "large language model", "training data", "cutoff date",
    "对不起", "抱歉", "语言模型", "无法访问", "没有访问", "作为ai", "你好", "提供帮助", "javascript", "const numbers",
)
CAPTIONER_REFUSALS = (
    "sorry", "cannot browse", "can't browse", "unable to browse", "not able to browse", "large language model", "training data",
    "cutoff date", "as an ai", "i am an ai", "don't have access", "not sure what you are asking", "clarify your question", "how can i help",
)
STORED_REFUSALS = (
    "sorry", "browse the internet", "cannot browse", "can't browse", "unable to browse", "not able to browse", "large language model",
    "training data", "cutoff date", "as an ai", "i am an ai", "对不起", "抱歉", "语言模型", "无法访问", "没有访问", "作为ai",
    "作为一个ai", "你好", "提供帮助", "误解了", "javascript", "const numbers",
)
DEFAULT_CAPTION = "Visual keyframe capturing scene activity and subjects."
ALLOWED_EXTENSIONS = (".mp4", ".mkv", ".mov", ".webm", ".avi")
TOKEN = r"[\p{L}\p{N}_]+"


#: White space of every kind at either end, the separators of information included.
_ENDS = r"^[\s\x1C-\x1F\x{85}\p{Z}]+|[\s\x1C-\x1F\x{85}\p{Z}]+$"


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, _ENDS, "")


def literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def plain(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def keyword_matches(text: Column, keywords: Column) -> Column:
    """How many of the keywords occur in the text, as substrings."""
    return F.size(F.filter(keywords, lambda k: F.contains(text, k))).cast("long")


def any_keyword(text: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: F.contains(text, k))


def refused(caption: Column, phrases: Sequence[str] = STORED_REFUSALS) -> Column:
    return F.coalesce(any_keyword(F.lower(caption), literals(phrases)) | any_keyword(caption, literals(phrases)), F.lit(False))


def clean_caption(caption: Column, phrases: Sequence[str] = PREVIEW_REFUSALS) -> Column:
    """The caption, or a neutral text where it is missing, empty or a refusal."""
    return F.when(F.coalesce(caption, F.lit("")) == "", F.lit(DEFAULT_CAPTION)).when(refused(caption, phrases), F.lit(DEFAULT_CAPTION)).otherwise(caption)


def scene_caption(text: Column, n_frames: Column) -> Column:
    """What a captioner said of a scene: nothing without frames, and a plain sentence
    where it failed (null), said nothing or refused."""
    said = stripped(text)
    plain_ = F.format_string("Scene showing keyframe visuals with %d frames, subjects and ongoing activity.", n_frames)
    bad = said.isNull() | (said == "") | any_keyword(F.lower(said), literals(CAPTIONER_REFUSALS))
    return F.when(n_frames == 0, F.lit("")).when(F.coalesce(bad, F.lit(True)), plain_).otherwise(said)


def keyframe_name(ts: Column) -> Column:
    return F.format_string("f_%.2fs.jpg", ts.cast("double"))


def allowed_file(name: Column) -> Column:
    """The last dot's ending is an allowed one, in any case; a leading dot starts no ending."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)$", 1)).isin(*ALLOWED_EXTENSIONS)


def srt_time(seconds: Column) -> Column:
    whole = F.floor(seconds)
    millis = F.floor((seconds - whole) * 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(seconds / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60)), millis)


def srt_block(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), stripped(F.coalesce(text, F.lit(""))), F.lit("\n\n"))


def clip_name(video_id: Column, start: Column, end: Column, subtitles: bool = False) -> Column:
    tag = "_sub" if subtitles else ""
    return F.format_string(f"moment_%s_%.1f_%.1f{tag}.mp4", F.substring(video_id.cast("string"), 1, 8), start, end)


def heat_band(value: Column) -> Column:
    return F.when(value >= 0.75, "high").when(value >= 0.5, "medium").when(value >= 0.3, "low").otherwise("none")
