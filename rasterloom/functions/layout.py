"""Column functions of sheet geometry, insets, margins, names of formats and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of layer modes by their number in the file format, directions as other tools spell them, preset palettes.
BLEND_MODES = "normal multiply screen overlay darken lighten color-dodge color-burn hard-light soft-light difference exclusion hue saturation color luminosity addition subtract divide".split()
DIRECTIONS = {"forward": "forward", "reverse": "reverse", "pingpong": "pingpong", "pingpong-reverse": "pingpong_reverse"}
PRESETS = {
    "gameboy": ["#0f380f", "#306230", "#8bac0f", "#9bbc0f"],
    "gameboy-pocket": ["#1a1a1a", "#555555", "#aaaaaa", "#e6e6e6"],
    "mono": ["#000000", "#ffffff"],
}
SEVERITIES = ["info", "warning", "error"]
#: Backgrounds that a completed part may be keyed by.
BACKGROUNDS = ["#00ff00", "#ff00ff", "#00ffff", "#ff8000"]


def cell_of(index: Column, cols: Column) -> Column:
    """(row, col) of a frame by its number."""
    c = F.greatest(F.lit(1), cols)
    return F.struct(F.floor(index / c).cast("long").alias("row"), (index % c).cast("int").alias("col"))


def index_of(row: Column, col: Column, cols: Column) -> Column:
    return row * F.greatest(F.lit(1), cols) + col


def origin_of(row: Column, col: Column, width: Column, height: Column, left: Column, top: Column, space_x: Column, space_y: Column) -> Column:
    """(x, y) of a cell's first pixel on its sheet."""
    return F.struct((left + col * (width + space_x)).cast("long").alias("x"), (top + row * (height + space_y)).cast("long").alias("y"))


def pixel_offset(x: Column, y: Column, width: Column) -> Column:
    """The place of a pixel's first byte in rows of four bytes a pixel."""
    return (y.cast("long") * width + x) * 4


def is_zero(*sides: Column) -> Column:
    """Whether no side and no gutter has any padding."""
    none = F.lit(True)
    for s in sides:
        none = none & (F.coalesce(s, F.lit(0)) == 0)
    return none


def composed_crop(base: dict[str, Column], inner: dict[str, Column]) -> Column:
    """A crop (shares of each side) within a crop, as one of the whole raster."""
    wide, high = 1 - base["left"] - base["right"], 1 - base["top"] - base["bottom"]
    return F.struct(*[(base[s] + inner[s] * (wide if s in ("left", "right") else high)).alias(s) for s in ("top", "bottom", "left", "right")])


def _whole(x: Column) -> Column:
    """A number of pixels: not below 0, not a fraction, 0 for what is no number."""
    usual = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return F.when(usual, F.greatest(F.lit(0), F.floor(x))).otherwise(0).cast("int")


def fitted_pair(a: Column, b: Column, room: Column) -> tuple[Column, Column]:
    """Two insets that fit in a length: first the larger one gives way, then both in turn, the larger one first."""
    over = a + b - room
    gap = F.abs(a - b)
    high, low = F.greatest(a, b), F.least(a, b)
    rest = over - gap
    large = F.when(over <= gap, high - over).otherwise(F.greatest(F.lit(0), low - F.ceil(rest / 2)))
    small = F.when(over <= gap, low).otherwise(F.greatest(F.lit(0), low - F.floor(rest / 2)))
    pick = lambda first: F.when(over <= 0, a if first else b).when(room <= 0, 0).otherwise(F.when((a >= b) == F.lit(first), large).otherwise(small)).cast("int")
    return pick(True), pick(False)


def clamped_insets(left: Column, right: Column, top: Column, bottom: Column, width: Column, height: Column, middle: int = 1) -> Column:
    """Insets that leave at least `middle` pixels between them on each axis."""
    across = fitted_pair(_whole(left), _whole(right), F.greatest(F.lit(0), _whole(width) - middle))
    down = fitted_pair(_whole(top), _whole(bottom), F.greatest(F.lit(0), _whole(height) - middle))
    return F.struct(across[0].alias("left"), across[1].alias("right"), down[0].alias("top"), down[1].alias("bottom"))


def required_margin(band: Column, outer: Column, blur: Column, dx: Column, dy: Column, shadow: Column) -> Column:
    """What an outer band of a width and a shadow of a blur and an offset need around a raster, on each side."""
    foot = F.when(outer, band).otherwise(0)
    side = lambda shift: F.ceil(F.when(shadow, F.greatest(foot, F.greatest(F.lit(0), shift) + blur + foot)).otherwise(foot)).cast("int")
    return F.struct(side(-dx).alias("left"), side(-dy).alias("top"), side(dx).alias("right"), side(dy).alias("bottom"))


def at_least(severity: Column, floor: str) -> Column:
    """Whether a severity is not below one."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) >= SEVERITIES.index(floor) + 1


def blend_mode(number: Column) -> Column:
    """A layer mode's name; null for a number that has none."""
    return F.get(F.array(*map(F.lit, BLEND_MODES)), F.when((number >= 0) & (number < len(BLEND_MODES)), number).otherwise(-1).cast("int"))


def direction_name(direction: Column) -> Column:
    """A tag's direction as other tools spell it; forward for any other."""
    found = F.lit("forward")
    for ours, theirs in DIRECTIONS.items():
        found = F.when(direction == ours, theirs).otherwise(found)
    return found


def is_layered_name(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(ase|aseprite)$")


def is_nine_patch_name(name: Column) -> Column:
    return F.lower(name).endswith(".9.png")


def is_layered_file(head: Column) -> Column:
    """Whether a binary value has the layered format's number, 0xA5E0 at byte 4 (little-endian)."""
    return F.hex(F.substring(head, 5, 2)) == "E0A5"


def is_base64(text: Column) -> Column:
    return text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{4})$")


def export_kind(document: Column) -> Column:
    """What geometry a JSON document offers: atlas (a map of frames), grid (cell sizes and counts), hybrid or unknown."""
    number = lambda path: F.expr("1.0d") * F.get_json_object(document, path).try_cast("double")
    frames = F.get_json_object(document, "$.frames")
    atlas = F.coalesce(frames.startswith("{") & (frames != "{}"), F.lit(False))
    grid = F.lit(True)
    for path in ("$.frameWidth", "$.frameHeight", "$.grid.cols", "$.grid.rows"):
        grid = grid & F.coalesce(number(path) > 0, F.lit(False))
    return F.when(atlas & grid, "hybrid").when(atlas, "atlas").when(grid, "grid").otherwise("unknown")


def normalized_holds(holds: Column, frames: Column) -> Column:
    """Holds cut or filled up with nulls to a number of frames, as whole positive milliseconds; null if none is left."""
    own = lambda i: F.floor(F.get(holds, i) + 0.5).cast("int")
    one = lambda i: F.when((F.get(holds, i) > 0) & ~F.isnan(F.get(holds, i)) & (F.get(holds, i) < 2**31) & (own(i) > 0), own(i))
    out = F.transform(F.sequence(F.lit(0), frames - 1), one)
    return F.when((frames > 0) & F.exists(F.coalesce(out, F.array().cast("array<int>")), lambda x: x.isNotNull()), out)


def toggled(current: Column, name: Column, choices: Column) -> Column:
    """The next selection of layers after a click on a name: null stands for all of the choices, and is what a full one becomes.
    A click on what is no choice, or one that would leave none, changes nothing."""
    base = F.coalesce(current, choices)
    next_ = F.when(F.array_contains(base, name), F.array_remove(base, name)).otherwise(F.concat(base, F.array(name)))
    kept = F.size(F.array_intersect(next_, choices)) > 0
    full = F.size(F.array_except(choices, next_)) == 0
    return F.when(~F.array_contains(choices, name) | ~kept, current).when(full, F.lit(None)).otherwise(next_)


def settings_error(fps: Column, start: Column, end: Column, least: Column, most: Column, columns: Column) -> Column:
    """The first rule that settings of a clip break, or null."""
    shape = fps.between(1, 24) & start.between(0, 30) & (end.isNull() | ((end > 0) & (end <= 30))) & least.between(0.1, 30) & most.between(0.1, 30) & columns.between(1, 32)
    return F.when(~F.coalesce(shape, F.lit(False)), "range").when(end <= start, "trim").when(least > most, "loop")


def fnv64(text: Column) -> Column:
    """(hi, lo): the 64-bit FNV-1a hash of a text's bytes and eight zeros, as two halves of 32 bits."""
    digits = F.concat(F.hex(text.cast("binary")), F.lit("00" * 8))
    values = F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    low32 = F.lit(0xFFFFFFFF)

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        product = lo * 0x1B3
        return F.struct((h["hi"] * 0x1B3 + F.shiftright(product, 32) + lo * 256).bitwiseAND(low32).alias("hi"), product.bitwiseAND(low32).alias("lo"))

    return F.aggregate(values, F.struct(F.lit(0xCBF29CE4).alias("hi"), F.lit(0x84222325).alias("lo")), step)


def internal_id(seed: Column) -> Column:
    """A stable number between -2^52 and 2^52, never 0."""
    h = fnv64(seed)
    found = h["hi"].bitwiseAND(0x1FFFFF) * (1 << 32) + h["lo"] - (1 << 52)
    return F.when(found == 0, 1).otherwise(found).cast("long")


def sprite_id(internal: Column) -> Column:
    """Four 32-bit groups of hexadecimal digits, the lowest digit first."""
    group = lambda v: F.reverse(F.lpad(F.lower(F.hex(v)), 8, "0"))
    return F.concat(group(internal.bitwiseAND(0xFFFFFFFF)), group(F.shiftright(internal, 32).bitwiseAND(0xFFFFFFFF)), F.lit("08000000" + "0" * 8))


def asset_guid(first_seed: Column, second_seed: Column) -> Column:
    """32 hexadecimal digits of the hashes of two seeds."""
    digits = lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")
    a, b = fnv64(first_seed), fnv64(second_seed)
    return F.concat(digits(a["hi"]), digits(a["lo"]), digits(b["hi"]), digits(b["lo"]))
