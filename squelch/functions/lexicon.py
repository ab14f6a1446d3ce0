"""Fixed values of the radio domain: word lists, phrases and thresholds."""

from __future__ import annotations

# They must equal the published lists for equal results.
NATO_PHONETIC = (
    "alfa alpha bravo charlie delta echo foxtrot golf hotel india juliet juliett kilo lima mike november "
    "oscar papa quebec romeo sierra tango uniform victor whiskey xray x-ray yankee zulu"
).split()
NUMBER_WORDS = "zero one two three four five six seven eight nine niner tree fower fife ten eleven twelve hundred thousand decimal point".split()
ATC_WORDS = (
    "affirm affirmative altitude approach backtrack cleared clearance climb contact cross decimal departure descend direct expect "
    "flight frequency ground heading hold identified join knots land landing level line maintain negative qnh radar readback reduce "
    "report roger runway squawk speed startup takeoff taxi tower traffic turn vacate via wilco wind"
).split()
FILLER_TOKENS = "uh um erm hmm ah eh noise unk unintelligible".split()
DIGIT_WORDS = "zero one two three four five six seven eight nine".split()
ICAO_NUMBERS = {"niner": "nine", "tree": "three", "fife": "five", "fower": "four", "decimal": "point", "dot": "point"}
OFF_DOMAIN_PHRASES = (
    "thank you for watching", "thanks for watching", "like and subscribe", "please subscribe", "subscribe to", "captions by",
    "transcribed by", "subtitles by", "translated by", "as an ai", "i'm sorry but",
)
CONVERSATIONAL_PHRASES = ("here is", "i think", "let's", "okay so", "you know", "lovely to see you", "the following is")
EDGE_MARKS = "\"'`“”‘’.,;:!?()[]{}<>"
NON_LATIN_SHARE, REPEAT_RUNS, REPEAT_TOKENS, CHARS_PER_SECOND, CONTENT_TOKENS, CONTENT_SHARE = 0.15, 3, 6, 30.0, 4, 0.2
FLAGS_VERSION = 3001
NEAR_THRESHOLD = 0.8
# What airlines are called on the radio, by the designator of their callsigns.
TELEPHONY = {
    "AAL": "American", "AAY": "Allegiant", "ACA": "Air Canada", "AFR": "Airfrance", "ASA": "Alaska", "ASH": "Air Shuttle", "ATN": "Air Transport",
    "BAW": "Speedbird", "CJC": "Colgan", "CKS": "Connie", "CMP": "Copa", "DAL": "Delta", "DLH": "Lufthansa", "EDV": "Endeavor", "EJA": "Execjet",
    "ENY": "Envoy", "FDX": "FedEx", "FFT": "Frontier Flight", "GJS": "Lindbergh", "GTI": "Giant", "ICE": "Iceair", "JBU": "JetBlue",
    "JIA": "Blue Streak", "JZA": "Jazz", "KLM": "KLM", "LXJ": "Flexjet", "MXY": "Moxy", "NKS": "Spirit Wings", "PDT": "Piedmont", "QXE": "Horizon",
    "RPA": "Brickyard", "SCX": "Sun Country", "SKW": "SkyWest", "SWA": "Southwest", "UAL": "United", "UPS": "UPS", "VIR": "Virgin", "VXP": "Avelo",
    "WJA": "WestJet",
}
