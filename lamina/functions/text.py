"""String rules of the editor, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import number_text, round_half_up, text_or

# Families by the words that a prompt may contain, the first that matches wins.
ANIMATION_FAMILIES = {
    "slime": ("slime", "jelly", "blob", "squish", "bounce"),
    "coin": ("coin", "spin", "rotate", "orb", "globe"),
    "fire": ("fire", "flame", "burn", "plasma", "spark", "explosion", "hot"),
    "slash": ("sword", "slash", "blade", "strike", "cut", "impact"),
    "flyer": ("bird", "bat", "wing", "fly", "flight", "ghost", "hover"),
}
# Motions by the words of a prompt, the first that matches wins.
MOTIONS = {
    "walk": ("walk", "run", "走", "跑"),
    "attack": ("attack", "slash", "hit", "攻击", "挥", "砍"),
    "jump": ("jump", "跳"),
    "magic": ("magic", "spell", "cast", "fire", "glow", "spark", "魔法", "施法", "火", "光", "粒子"),
}
ILLEGAL_IN_FILENAMES = r'[<>:"/\\|?*\x00-\x1f]+'
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "gif")


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, "^_+|_+$", "")


def safe_name(x: Column) -> Column:
    """Lower-case letters, digits and CJK ideographs, other runs as one underscore."""
    return text_or(F.lower(_trimmed(F.regexp_replace(x, "[^a-zA-Z0-9一-龥]+", "_"))), "sprite")


def safe_filename(x: Column) -> Column:
    return text_or(_trimmed(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_")), "spritesheet")


def download_filename(x: Column, extension: str) -> Column:
    """The base name without what file systems refuse, ending in ``extension``."""
    fallback = f"spritesheet_export.{extension}"
    base = F.regexp_extract(F.regexp_replace(F.coalesce(x, F.lit(fallback)), "/+$", ""), "([^/]*)$", 1)
    clean = base
    for pattern in (ILLEGAL_IN_FILENAMES, r"\s+", "_+"):
        clean = F.regexp_replace(clean, pattern, "_")
    clean = text_or(_trimmed(clean), fallback)
    return F.when(F.lower(clean).endswith(f".{extension}"), clean).otherwise(F.concat(without_extension(clean), F.lit(f".{extension}")))


def without_extension(x: Column) -> Column:
    return F.regexp_replace(x, r"\.[^.]+$", "")


def css_url(x: Column) -> Column:
    return F.concat(F.lit('url("'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('")'))


def split_tags(x: Column) -> Column:
    return F.filter(F.split(x, r"[,\s]+"), lambda t: t != "")


def escape_markup(x: Column) -> Column:
    """& goes first, or it would be escaped twice."""
    for raw, escaped in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(raw), F.lit(escaped))
    return x


def trim_markup(x: Column, tag: str = "svg", wrapper: str = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 256 256" width="256" height="256">') -> Column:
    """From the first opening ``tag`` (or wrapped in one) through its last closing tag."""
    x, close = F.trim(F.coalesce(x, F.lit(""))), f"</{tag}>"
    first = F.instr(x, f"<{tag}")
    opened = F.when(first > 0, x.substr(first, F.length(x))).otherwise(F.concat(F.lit(wrapper), x, F.lit(close)))
    back = F.instr(F.reverse(opened), close[::-1])
    return F.when(back > 0, opened.substr(F.lit(1), F.length(opened) - back + 1)).otherwise(opened)


def markup_body(x: Column, tag: str = "svg") -> Column:
    """What stands between the opening tag's end and the last closing tag."""
    x = trim_markup(x, tag)
    start, back = F.instr(x, ">"), F.instr(F.reverse(x), f"</{tag}>"[::-1])
    return F.when((start > 0) & (back > 0), x.substr(start + 1, F.greatest(F.lit(0), F.length(x) - back - len(tag) - 2 - start))).otherwise(x)


def default_trigger_value(kind: Column) -> Column:
    return F.when(kind == "auto", "auto").when(kind == "mouse", "click").when(kind == "keyboard", "KeyF").otherwise("scene.animation.active")


def default_game_state(kind: Column, action: Column) -> Column:
    key = safe_name(text_or(action, "animation"))
    return F.when(kind == "auto", F.concat(F.lit("scene."), key, F.lit(".loop"))).when(kind == "mouse", F.concat(F.lit("scene."), key, F.lit(".clicked"))).when(kind == "keyboard", F.concat(F.lit("input."), key)).otherwise(F.concat(F.lit("state."), key))


def key_label(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "E").otherwise(text_or(F.regexp_replace(F.regexp_replace(value, "(?i)^Key", ""), "(?i)^Digit", ""), value))


def clip_label(direction: Column, action: Column, name: Column, trigger_type: Column, trigger_value: Column) -> Column:
    key = F.when(trigger_type == "keyboard", F.concat(F.lit(" "), F.regexp_replace(trigger_value, "(?i)^Key", ""))).otherwise("")
    return F.when(direction == "left", F.concat(F.lit("Walk Left"), key)).when(direction == "right", F.concat(F.lit("Walk Right"), key)).when(action == "idle", "Idle").otherwise(name)


def file_size(n: Column) -> Column:
    mega = 1024 * 1024
    small = F.concat(F.greatest(F.lit(1), round_half_up(n / 1024)).cast("string"), F.lit(" KB"))
    return F.when(n.isNull() | (n <= 0), "0 KB").when(n < mega, small).otherwise(F.concat(F.format_string("%.1f", n / mega), F.lit(" MB")))


def viewport_ratio(width: Column, height: Column) -> Column:
    none = width.isNull() | height.isNull() | (width == 0) | (height == 0)
    return F.when(none, "custom").when(width >= height, F.concat(F.format_string("%.2f", width / height), F.lit(":1"))).otherwise(F.concat(F.lit("1:"), F.format_string("%.2f", height / width)))


def rgba(colour: Column, opacity: Column) -> Column:
    """#rrggbb as rgba(); other texts stay."""
    pattern = "^#?([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})$"
    parts = [F.conv(F.regexp_extract(colour, pattern, k), 16, 10) for k in (1, 2, 3)]
    return F.when(colour.rlike(pattern), F.concat(F.lit("rgba("), F.concat_ws(", ", *parts, number_text(opacity)), F.lit(")"))).otherwise(colour)


def first_family(text: Column, families: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    """The first family one of whose words is a substring of the lower-cased text."""
    t, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, words in families.items():
        hit = t.contains(words[0])
        for w in words[1:]:
            hit = hit | t.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def animation_family(prompt: Column) -> Column:
    return first_family(prompt, ANIMATION_FAMILIES, "astral")


def motion(prompt: Column) -> Column:
    return first_family(prompt, MOTIONS, "idle")


def data_url(x: Column) -> Column:
    """struct(extension, content) of an inline image; null if it isn't one of the kinds that are accepted."""
    pattern = r"^data:image/(png|jpeg|jpg|webp);base64,(.+)$"
    kind = F.regexp_extract(x, pattern, 1)
    return F.when(x.rlike(pattern), F.struct(F.when(kind == "jpeg", "jpg").otherwise(kind).alias("extension"), F.unbase64(F.regexp_extract(x, pattern, 2)).alias("content")))


def guarded_path(url: Column, prefix: str = "/generated/") -> Column:
    """struct(status, path) of a URL: 200 and the path under ``prefix``, or 400 where it leaves it."""
    path = F.when(url.rlike("(?i)^https?://"), F.regexp_replace(url, "(?i)^https?://[^/?#]*", "")).otherwise(url)
    path = F.try_url_decode(F.replace(F.regexp_extract(path, "^([^?#]*)", 1), F.lit("+"), F.lit("%2B")))
    steps = F.split(path.substr(F.lit(len(prefix) + 1), F.length(path)), "/")
    # Depth after each step: below zero means outside, whatever comes later.
    depth = F.aggregate(
        steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda d, s: (lambda now: F.struct(now.alias("now"), F.least(d["least"], now).alias("least")))(d["now"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)),
    )["least"]
    good = F.coalesce(path.startswith(prefix) & (depth >= 0), F.lit(False))
    return F.struct(F.when(good, 200).otherwise(400).alias("status"), F.when(good, path.substr(F.lit(len(prefix) + 1), F.length(path))).alias("path"))


def filter_text(*parts: Column) -> Column:
    """Style filters joined by blanks without nulls, blanks and ``none``; ``none`` if nothing is left."""
    return text_or(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "") & (p != "none")), " "), "none")
