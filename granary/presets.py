"""Languages as parameters: script ranges, marker letters, thresholds. The engine has no language of its own."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Preset:
    name: str
    script: str  #: inside of a character class: the script's block
    letters: str = r"\p{L}"  #: a class of all letters, as regex
    min_ratio: float = 0.5
    markers: str = ""  #: letters that tell the language from others of its script; empty: no such test
    min_block_chars: int = 30
    min_marker_ratio: float = 0.005
    exempt_suffix: str = "ocr"
    nfc: bool = False
    split_all_lines: bool = True  #: at every line separator with lines stripped; else at \n only, lines as they are
    replacements: dict[str, str] = field(default_factory=dict)


# Blocks, markers and thresholds of the supported languages.
DEVANAGARI = Preset("hindi", r"\x{0900}-\x{097F}", nfc=True, split_all_lines=False)
ASSAMESE = Preset("assamese", r"\x{0980}-\x{09FF}", markers="ৰৱ", replacements={"র": "ৰ"})
#: Serves Latin tables; its constants let every branch occur in them.
LATIN = Preset("latin", "A-Za-z", min_ratio=0.95)
FRENCH = Preset("french", "A-Za-zÀ-ÖØ-öø-ÿ", markers="éèêç")
#: Like LATIN, with marker letters that some of its languages lack, and a source suffix that is exempt.
MARKED = Preset("marked", "A-Za-z", min_ratio=0.95, markers="kw", min_marker_ratio=0.01, exempt_suffix="7")
#: Normalised first, split at \n only, lines as they are.
ACCENTED = Preset("accented", "A-Za-z", min_ratio=0.9, nfc=True, split_all_lines=False)
