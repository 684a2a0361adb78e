"""Fixed values that results depend on."""

# Pitch geometry in metres.
PITCH_LENGTH = 105.0
PITCH_WIDTH = 68.0
BOX_X = (88.5, 105.0)
BOX_Y = (13.84, 54.16)
FINAL_THIRD_X = 70.0
GRID_X, GRID_Y = 12, 8

# Restarts that are not open play.
SET_PIECES = ["Corner", "Free Kick", "Throw-in", "Kick Off", "Goal Kick"]

# Style count -> family.
FAMILIES = {
    "shots": "shooting",
    "box_shots": "shooting",
    "shot_assists": "creation",
    "crosses": "creation",
    "box_passes": "creation",
    "passes": "passing",
    "long_passes": "passing",
    "progressive_passes": "passing",
    "final_third_passes": "passing",
    "carries": "carrying",
    "progressive_carries": "carrying",
    "carry_distance": "carrying",
    "box_carries": "carrying",
    "pressures": "defending",
    "counterpressures": "defending",
    "tackles": "defending",
    "interceptions": "defending",
    "recoveries": "defending",
}
OUTPUT_COUNTS = ["goals", "npxg", "xa", "completed_passes"]
CONTEXT_COUNTS = ["own_possessions", "opponent_possessions", "team_passes"]

# Role adjacency (unordered).
ADJACENT_ROLES = [
    ("CB", "FB/WB"),
    ("CB", "DM"),
    ("DM", "CM"),
    ("CM", "AM"),
    ("AM", "W"),
    ("W", "ST"),
    ("W", "FB/WB"),
]

# Tags and codes of the tagged event feed.
TAG_ACCURATE, TAG_INACCURATE = 1801, 1802
TAG_GOAL_ZONES = [101, 1201, 1202, 1203, 1204, 1205, 1206, 1207, 1208, 1209]
TAG_BLOCKED = 2101
TAG_KEY_PASS, TAG_SLIDING, TAG_INTERCEPTION = 302, 1601, 1401
TAG_LOST, TAG_NEUTRAL, TAG_WON = 701, 702, 703
TAG_SENT_OFF = [1701, 1703]

# Identifier parts.
UUID_NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"

# Thresholds.
THRESHOLDS = [450, 600, 900, 1200]
MINIMUM_ROLE_SIZE = 12
EPSILON = 1e-9
EXACT_TOLERANCE = 10.0
