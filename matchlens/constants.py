"""Word lists, weights, thresholds and labels that results depend on."""

# --- composite score -----------------------------------------------------------------------------
# Default weight per counting stat.
FANTASY_WEIGHTS = {
    "kills": 1.0,
    "aces": 1.5,
    "digs": 0.5,
    "assists": 0.25,
    "block_solos": 1.0,
    "block_assists": 0.5,
    "errors": -0.5,
    "serr": -0.5,
    "rerr": -0.25,
    "berr": -0.25,
    "bhe": -0.25,
}
WEIGHT_LIMIT = 10.0

# --- leaderboards --------------------------------------------------------------------------------
# Rankable stats and the columns shown beside every ranked value.
SEASON_STATS = (
    "kills", "errors", "total_attacks", "assists", "aces", "serr", "digs", "retatt", "rerr",
    "block_solos", "block_assists", "total_blocks", "berr", "pts", "bhe", "hit_pct",
    "kills_per_set", "assists_per_set", "aces_per_set", "digs_per_set", "blocks_per_set",
    "pts_per_set",
)
LEADER_COMPONENTS = (
    "kills", "errors", "total_attacks", "assists", "aces", "digs", "block_solos", "block_assists",
    "total_blocks", "pts", "retatt", "hit_pct",
)
GAME_STATS = ("kills", "assists", "digs", "aces", "total_blocks", "pts", "errors", "total_attacks")
TEAM_SORTS = (
    "kills", "assists", "aces", "digs", "total_blocks", "pts", "errors", "total_attacks", "hit_pct",
)
TRANSFER_SORTS = (
    "pts_per_set", "kills_per_set", "assists_per_set", "digs_per_set", "aces_per_set",
    "blocks_per_set", "hit_pct", "pts", "kills", "assists", "digs", "aces", "total_blocks",
)
DEFENSE_SORTS = ("opp_hit_pct", "opp_kills", "opp_total_attacks")

# Adaptive sample floor, as (column, per-match rate, smallest floor).
QUALIFIER_QUANTILE = 0.75
QUALIFIERS = {
    "hit_pct": ("attacks", 6.67, 10),
    "kills_per_set": ("sets", 2.0, 3),
    "assists_per_set": ("sets", 2.0, 3),
    "digs_per_set": ("sets", 2.0, 3),
    "aces_per_set": ("sets", 2.0, 3),
    "blocks_per_set": ("sets", 2.0, 3),
    "pts_per_set": ("sets", 2.0, 3),
}
TOOL_LIMIT = 100
API_LIMIT = 500
CONTEST_LIMIT = 5000

# --- geography -----------------------------------------------------------------------------------
# US states with postal codes, territory codes, and country spellings.
US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA",
    "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH",
    "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC",
    "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN",
    "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
US_TERRITORIES = ("PR", "VI", "GU", "AS", "MP")
DOMESTIC_TAILS = (*US_STATES.values(), *US_TERRITORIES)
COUNTRY_ALIASES = {
    "usa": "US", "us": "US", "u.s.": "US", "u.s.a.": "US", "united states": "US",
    "united states of america": "US", "america": "US",
    "uk": "United Kingdom", "great britain": "United Kingdom", "england": "United Kingdom",
    "czech republic": "Czechia", "holland": "Netherlands",
}

# --- positions and classes -----------------------------------------------------------------------
# Spelled-out positions, and class codes in order of age.
POSITION_WORDS = {
    "setter": "S", "outside": "OH", "outside hitter": "OH", "pin": "OH", "middle": "MB",
    "middle blocker": "MB", "libero": "L", "opposite": "OPP", "right side": "RS",
    "rightside": "RS", "defensive specialist": "DS",
}
CLASS_ORDINALS = {"Fr": 1, "So": 2, "Jr": 3, "Sr": 4, "Gr": 5}
STAFF_WORDS = (
    "coach", "assistant", "director", "consultant", "coordinator", "analyst", "trainer", "manager",
    "intern", "video", "strength", "operations", "development", "technical", "volunteer",
    "graduate assistant",
)
LIBERO_POSITIONS = ("L", "DS")
SCHOOL_STOP_WORDS = ("university", "college", "of", "the")

# --- roster corrections --------------------------------------------------------------------------
# Fixed values: (source player id, forced height in inches, forced position).
ROSTER_OVERRIDES = (
    ("11429162", 72, None),
    ("9998402", 72, None),
    ("11429149", None, "MB"),
)

# --- conference labels ---------------------------------------------------------------------------
# Feed label -> full conference name.
CONFERENCE_ALIASES = {
    "America East": "America East Conference",
    "American": "American Conference",
    "Atlantic 10": "Atlantic 10 Conference",
    "ACC": "Atlantic Coast Conference",
    "ASUN": "Atlantic Sun Conference",
    "Big 12": "Big 12 Conference",
    "Big East": "Big East Conference",
    "Big Sky": "Big Sky Conference",
    "Big South": "Big South Conference",
    "Big Ten": "Big Ten Conference",
    "Big West": "Big West Conference",
    "CAA": "Coastal Athletic Association",
    "CUSA": "Conference USA",
    "C-USA": "Conference USA",
    "Horizon": "Horizon League",
    "Metro": "Metro Atlantic Athletic Conference",
    "MAAC": "Metro Atlantic Athletic Conference",
    "MAC": "Mid-American Conference",
    "MEAC": "Mid-Eastern Athletic Conference",
    "MVC": "Missouri Valley Conference",
    "Mountain West": "Mountain West Conference",
    "OVC": "Ohio Valley Conference",
    "Pac-12": "Pac-12 Conference",
    "Patriot": "Patriot League",
    "SEC": "Southeastern Conference",
    "SoCon": "Southern Conference",
    "Southland": "Southland Conference",
    "Summit League": "The Summit League",
    "Sun Belt": "Sun Belt Conference",
    "SWAC": "Southwestern Athletic Conference",
    "WAC": "Western Athletic Conference",
    "WCC": "West Coast Conference",
}

# --- broadcast networks --------------------------------------------------------------------------
# Networks with local affiliates, as (word in the channel name, network).
AFFILIATED_NETWORKS = (
    ("THE CW", "CW"), ("CW", "CW"), ("FOX", "FOX"), ("ABC", "ABC"), ("NBC", "NBC"), ("CBS", "CBS"),
)
# Channel texts that are never listed.
DROPPED_CHANNELS = ("disney+", "disney +", "disney plus", "radio", ".sxm", "siriusxm", "sirius xm")
# Fixed values: (pattern, label, logo), first match wins.
NETWORK_RULES = (
    (r"\bespn\s*news\b", "ESPNews", None),
    (r"\bespn\s*u\b|espnu", "ESPNU", "espnu"),
    (r"\bespn\s*2\b|espn2", "ESPN2", "espn2"),
    (r"espn\s*\+|espn\s*plus|espnplus|watchespn", "ESPN+", "espn-plus"),
    (r"\bespn\s*1\b|espn1", "ESPN", "espn"),
    (r"espn\.com", "ESPN/ESPN+", "espn"),
    (r"\bespn\b", "ESPN", "espn"),
    (r"acc\s*n\s*x|acc\s*network\s*extra|accnx", "ACC Network Extra", "accnx"),
    (r"acc\s*network|accn\b", "ACC Network", "accn"),
    (r"sec\s*network\s*\+|sec\s*\+|secplus|sec\s*network\s*extra", "SEC Network+", "secn-plus"),
    (r"sec\s*network|secn\b", "SEC Network", "secn"),
    (r"big\s*ten\s*plus|big10\+|b1g\+|btn\s*\+|bigtenplus", "B1G+", "b1g-plus"),
    (r"big\s*ten\s*network|\bbtn\b", "Big Ten Network", "btn"),
    (r"\bb1g\b", "Big Ten Network", "btn"),
    (r"\bfs1\b|fox\s*sports\s*1", "FS1", "fs1"),
    (r"\bfs2\b|fox\s*sports\s*2", "FS2", "fs2"),
    (r"fox\s*one|fox\s*1\b", "FOX One", None),
    (r"fox\s*sports", "FOX Sports", None),
    (r"\bfox\b", "FOX", "fox"),
    (r"peacock", "Peacock", "peacock"),
    (r"paramount\s*\+|paramount\s*plus", "Paramount+", None),
    (r"\babc\b", "ABC", "abc"),
    (r"cbs\s*sports\s*network|cbssn", "CBS Sports Network", None),
    (r"\bcbs\b", "CBS", "cbs"),
    (r"\bnbc\b", "NBC", "nbc"),
    (r"pac\s*-?\s*12", "Pac-12 Network", "pac12"),
    (r"mountain\s*west|watch\.themw|themw\.com|\bmw\+", "MW+", "mw-plus"),
    (r"flo\s*sports|flo\s*volleyball|flo\s*college|flocollege|flosports", "FloSports", "flosports"),
    (r"big\s*west", "Big West", None),
    (r"midco", "Midco Sports Plus", None),
    (r"nec\s*front\s*row", "NEC Front Row", None),
    (r"swac\s*tv|tv\.swac", "SWAC TV", None),
    (r"patriot\s*league", "Patriot League Network", None),
    (r"meac", "MEAC Sports Network", None),
    (r"summit", "Summit League Network", None),
    (r"\bvbtv\b|volleyball\s*tv", "VolleyballTV", None),
    (r"byu\s*tv|byutv", "BYUtv", None),
    (r"longhorn\s*network|\blhn\b", "Longhorn Network", None),
    (r"youtube|@pac12", "YouTube", "youtube"),
)
GENERIC_NETWORK = "ESPN/ESPN+"
# Labels that name the same airing as the generic one more precisely.
SPECIFIC_NETWORKS = (
    "ESPN", "ESPN2", "ESPNU", "ESPN+", "ESPNews", "ACC Network Extra", "SEC Network+",
    "ACC Network", "SEC Network", "Longhorn Network",
)
# Title prefixes, separators and network words used when splitting a match title.
TITLE_PREFIXES = (
    r"^(?:BIG10\+|Flo Sports|FOX ONE|NFHS Network|VBTV|ESPN\+|Disney\+ Events|MiLB|FS1|FS2|Peacock)\s*\d+:\s*",
    r"^[A-Za-z0-9+.'&|/ ]{1,28}?\s\d{1,3}:\s*",
    r"^flovolleyball:\s*\d{4}\s*",
    r"^Volleyball\s*\((?:W|M)\)\s*",
    r"^(?:Women's|Men's) College Volleyball\s*:?\s*",
    r"^NCAA (?:Women's|Men's) Volleyball\s*:?\s*",
    r"^B1G (?:Women's|Men's) Volleyball\s*-\s*",
    r"^Players Era Volleyball Showcase\s*-\s*",
    r"^Showcase\s*[-–]\s*",
    r"^College Volleyball\s*:?\s*",
    r"^Beach Volleyball\s*:?\s*",
    r"^Volleyball\s*[:\-]\s*",
)
TITLE_SEPARATORS = (" vs. ", " vs ", " v. ", " at ", " @ ", " — ", " – ", " - ")
NETWORK_HINTS = (
    "fs1", "fs2", "fox", "espn", "espnu", "espn2", "btn", "big ten network", "peacock", "accn",
    "accnx", "sec network", "secn", "secplus", "sec+", "cbssn", "espn+", "espn plus", "disney+",
    "b1g+", "big10+", "flosports", "paramount+", "vbtv",
)

# --- play-by-play --------------------------------------------------------------------------------
# Fixed values: (text in a scoring play, outcome), errors first; touch words; wording of outcomes.
TERMINAL_WORDS = (
    ("ball handling error", "ball_handling_error"), ("attack error", "attack_error"),
    ("service error", "service_error"), ("reception error", "reception_error"),
    ("set error", "set_error"), ("block error", "block_error"), ("kill", "kill"), ("ace", "ace"),
    ("block", "block"),
)
TOUCH_WORDS = ("reception", "set", "attack", "dig", "block")
TERMINAL_PHRASES = {
    "kill": "Kill", "ace": "Ace", "block": "Block", "attack_error": "Attack error",
    "service_error": "Service error", "reception_error": "Reception error",
    "set_error": "Set error", "block_error": "Block error",
    "ball_handling_error": "Ball handling error", "other": "Point",
}
ROTATION_FIELDS = (
    "serve_rallies", "serve_won", "recv_rallies", "recv_won", "points_won", "points_lost", "kills",
    "attack_errors", "attack_attempts",
)

# --- scouting ------------------------------------------------------------------------------------
# Fixed values: (metric, label, higher is better, is a rate, category, kind, listed automatically).
METRICS = (
    ("hit_pct", "hitting %", True, True, "offense", "pct3", True),
    ("kills_per_set", "kills/set", True, True, "offense", "rate", True),
    ("assists_per_set", "assists/set", True, True, "offense", "rate", True),
    ("aces_per_set", "aces/set", True, True, "serve", "rate", True),
    ("digs_per_set", "digs/set", True, True, "defense", "rate", True),
    ("blocks_per_set", "blocks/set", True, True, "block", "rate", True),
    ("pts_per_set", "points/set", True, True, "offense", "rate", True),
    ("hit_errors_per_set", "hitting errors/set", False, True, "offense", "rate", True),
    ("middle_share", "middle-attack share", True, True, "offense", "pctshare", True),
    ("opp_hit_pct", "opponent hitting %", False, True, "defense", "pct3", True),
    ("opp_kills_per_set", "opponent kills/set", False, True, "defense", "rate", True),
    ("opp_aces_per_set", "aces allowed/set", False, True, "defense", "rate", True),
    ("opp_mid_hit_pct", "opp. middle hitting %", True, True, "defense", "pct3", False),
    ("opp_mid_atks_per_set", "opp. middle swings/set", True, True, "defense", "rate", False),
    ("opp_pin_hit_pct", "opp. pin hitting %", True, True, "defense", "pct3", False),
    ("opp_pin_atks_per_set", "opp. pin swings/set", True, True, "defense", "rate", False),
    ("win_pct", "win %", True, False, "resume", "pct3", True),
    ("set_pct", "set win %", True, False, "resume", "pct3", True),
    ("quality_wins", "quality wins", True, False, "resume", "int", True),
    ("sos", "strength of schedule", True, False, "resume", "pct3", True),
)
# Samples, percentiles and shares from which a report speaks of something.
MIN_DISTRIBUTION_MATCHES = 2
LOW_SAMPLE_MATCHES = 4
STRONG_PCT, WEAK_PCT, LIST_CAP = 85.0, 15.0, 6
HITTER_MIN_ATTACKS, BLOCKER_MIN_SETS, SETTER_MIN_ASSISTS = 30, 10, 30
SOLO_SETTER_SHARE, SECOND_SETTER_SHARE = 0.60, 0.30
# Lowest percentile and the adjective it earns.
BANDS = (
    (90, "elite"), (75, "strong"), (60, "above-average"), (40, "solid"), (25, "below-average"),
    (10, "weak"), (0, "poor"),
)
