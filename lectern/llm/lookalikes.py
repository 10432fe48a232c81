"""The table of look-alike characters: what passes for a Latin letter or a digit, and rules for the rest.

The lists hold what only the eye can tell. What Unicode says itself comes by
rule: compatibility forms by their decomposition, small capitals and letters of
other Latin kinds by their names, spaces, hyphens and marks by their category.
"""

import unicodedata

#: Letters that look like a Latin letter, and that letter, by script.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝѵɡ", "ABESIJKMHOPCTYXaesijopcyxhdqwvg", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανιορτυωϲϳγηκχ", "ABEZHIKMNOPTYXavioptuwcjynkx", strict=True))
ARMENIAN = dict(zip("ՍՏՕԼՀաոսօհցզյլ", "USOLZwnuohgqjl", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏎᏏᏒᏔᏙᏚᏞᏟᏢᏦᏭᏮᏳᏴ", "DRTAJEWMHYGhZ4bRWVSLCPKG6GB", strict=True))
COPTIC = dict(zip("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABEHIKMNOPCTYXopc", strict=True))
#: Latin letters beyond ASCII, signs and symbols that pass for an ASCII character.
LATIN = {chr(0x131): "i", chr(0x251): "a", chr(0x261): "g", chr(0x1C0): "l", chr(0x17F): "s", chr(0x2090): "a"}
SIGNS = dict(zip("‐‑‒⁃−∕⁄∣∶꞉‚ʼʹ′ˋ", "-----//|::,''''", strict=True))

#: Scripts whose letters stand in for Latin ones, as ranges; a whole word in one of them is an ordinary word.
RANGES = ((0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0x13A0, 0x13FF), (0x2C80, 0x2CFF))


def _by_name() -> dict[str, str]:
    """Latin letters whose name says which ASCII letter they are drawn like: small capitals and turned-free script forms."""
    out = {}
    for kind in ("LATIN LETTER SMALL CAPITAL", "LATIN SMALL LETTER SCRIPT", "LATIN SMALL LETTER DOTLESS", "LATIN EPIGRAPHIC LETTER SIDEWAYS"):
        for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
            try:
                c = unicodedata.lookup(f"{kind} {letter}")
            except KeyError:
                continue
            out[c] = letter.lower()
    return out


BY_NAME = _by_name()
LOOKALIKE = {**BY_NAME, **COPTIC, **CHEROKEE, **ARMENIAN, **CYRILLIC, **GREEK, **LATIN}
#: What a skeleton replaces beyond letters.
PROTOTYPE = {**SIGNS, **LOOKALIKE}
