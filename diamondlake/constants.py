"""Codes, thresholds and column names whose exact content decides the results."""

# --- fixed values: pitch log columns and their types -------------------------------------------
PITCH_TYPES = {
    "game_date": "date", "game_pk": "bigint", "game_type": "string",
    "home_team": "string", "away_team": "string",
    "inning": "int", "inning_topbot": "string",
    "outs_when_up": "int", "balls": "int", "strikes": "int",
    "on_1b": "double", "on_2b": "double", "on_3b": "double",
    "at_bat_number": "int", "pitch_number": "bigint",
    "pitcher": "bigint", "batter": "bigint",
    "p_throws": "string", "stand": "string",
    "pitch_type": "string", "release_speed": "double",
    "release_pos_x": "double", "release_pos_z": "double",
    "player_name": "string", "description": "string", "events": "string",
    "spin_rate": "double", "spin_axis": "double",
    "release_spin_rate": "double", "release_extension": "double",
    "plate_x": "double", "plate_z": "double", "zone": "double",
    "pfx_x": "double", "pfx_z": "double",
    "hit_distance_sc": "double", "launch_speed": "double", "launch_angle": "double",
    "estimated_ba_using_speedangle": "double",
    "estimated_woba_using_speedangle": "double",
    "woba_value": "double", "babip_value": "double", "iso_value": "double",
    "barrel": "double", "hard_contact": "double",
    "home_score": "int", "away_score": "int",
    "delta_home_win_exp": "double", "delta_run_exp": "double",
}

# --- fixed values: vendor spellings of the columns above ----------------------------------------
COLUMN_ALIASES = {
    "barrel_pct": "barrel", "is_barrel": "barrel",
    "hardhit": "hard_contact", "hard_hit": "hard_contact",
    "exit_velocity": "launch_speed", "exit_velo": "launch_speed",
    "la": "launch_angle",
    "xwoba": "estimated_woba_using_speedangle",
    "xwOBA": "estimated_woba_using_speedangle",
    "xba": "estimated_ba_using_speedangle",
    "pitcher_name": "player_name",
    "event": "events",
}

# --- fixed values: columns never used ------------------------------------------------------------
UNUSED_COLUMNS = [
    "fielder_2", "fielder_3", "fielder_4", "fielder_5",
    "fielder_6", "fielder_7", "fielder_8", "fielder_9",
    "if_fielding_alignment", "of_fielding_alignment",
    "post_home_score", "post_away_score",
    "event", "type", "launch_speed_angle",
]

# fixed values: what identifies a pitch
PITCH_KEY = ["game_pk", "at_bat_number", "pitch_number"]

# --- fixed values: events that end a plate appearance --------------------------------------------
PA_END_EVENTS = [
    "single", "double", "triple", "home_run",
    "strikeout", "strikeout_double_play",
    "walk", "hit_by_pitch",
    "field_out", "field_error", "fielders_choice", "fielders_choice_out",
    "grounded_into_double_play", "double_play", "triple_play",
    "sac_fly", "sac_bunt", "sac_fly_double_play",
    "catcher_interf", "batter_interference",
    "force_out", "sacrifice_bunt_double_play",
]

# --- fixed values: outs credited per event; anything else counts zero -----------------------------
OUTS_ON_EVENT = {
    "field_out": 1, "strikeout": 1, "strikeout_double_play": 2,
    "grounded_into_double_play": 2, "double_play": 2, "triple_play": 3,
    "sac_fly": 1, "sac_bunt": 1, "fielders_choice_out": 1,
    "sac_fly_double_play": 2, "sacrifice_bunt_double_play": 2,
}

# fixed values: event and pitch codes by meaning
HIT_EVENTS = ["single", "double", "triple", "home_run"]
STRIKEOUT_EVENTS = ["strikeout", "strikeout_double_play"]
FASTBALL_TYPES = ["FF", "SI", "FT"]
WHIFF_DESCRIPTIONS = ["swinging_strike", "swinging_strike_blocked"]

# --- fixed values: pitch type families ------------------------------------------------------------
PITCH_CATEGORIES = {
    "fastball": ["FF", "FT", "SI", "FC", "FS", "FO"],
    "breaking": ["SL", "CU", "KC", "CS", "SV", "WR"],
    "offspeed": ["CH", "EP", "SC", "KN", "UN", "PO"],
}

# --- fixed values: linear weights -----------------------------------------------------------------
WOBA_WEIGHTS = {
    "walk": 0.690, "hit_by_pitch": 0.722, "single": 0.878,
    "double": 1.242, "triple": 1.568, "home_run": 2.007,
}
SHRINKAGE_AB = 120
LEAGUE_WOBA_DEFAULT = 0.315

# --- fixed values: home venue per team ------------------------------------------------------------
VENUES = {
    "ARI": "Chase Field", "ATL": "Truist Park", "BAL": "Oriole Park at Camden Yards",
    "BOS": "Fenway Park", "CHC": "Wrigley Field", "CWS": "Rate Field",
    "CIN": "Great American Ball Park", "CLE": "Progressive Field",
    "COL": "Coors Field", "DET": "Comerica Park", "HOU": "Minute Maid Park",
    "KC": "Kauffman Stadium", "LAA": "Angel Stadium", "LAD": "Dodger Stadium",
    "MIA": "loanDepot park", "MIL": "American Family Field",
    "MIN": "Target Field", "NYM": "Citi Field", "NYY": "Yankee Stadium",
    "OAK": "Sutter Health Park", "PHI": "Citizens Bank Park",
    "PIT": "PNC Park", "SD": "Petco Park", "SF": "Oracle Park",
    "SEA": "T-Mobile Park", "STL": "Busch Stadium", "TB": "Steinbrenner Field",
    "TEX": "Globe Life Field", "TOR": "Rogers Centre", "WSH": "Nationals Park",
}

# --- fixed values: team code aliases and full names -----------------------------------------------
TEAM_ALIASES = {"CHW": "CWS", "CHA": "CWS", "OAK": "ATH", "ARI": "AZ"}
TEAM_NAMES = {
    "NYY": "New York Yankees", "BOS": "Boston Red Sox", "TB": "Tampa Bay Rays",
    "TOR": "Toronto Blue Jays", "BAL": "Baltimore Orioles", "CLE": "Cleveland Guardians",
    "DET": "Detroit Tigers", "MIN": "Minnesota Twins", "CWS": "Chicago White Sox",
    "KC": "Kansas City Royals", "HOU": "Houston Astros", "SEA": "Seattle Mariners",
    "TEX": "Texas Rangers", "LAA": "Los Angeles Angels", "ATH": "Athletics",
    "OAK": "Oakland Athletics", "ATL": "Atlanta Braves", "PHI": "Philadelphia Phillies",
    "NYM": "New York Mets", "MIA": "Miami Marlins", "WSH": "Washington Nationals",
    "MIL": "Milwaukee Brewers", "CHC": "Chicago Cubs", "STL": "St. Louis Cardinals",
    "PIT": "Pittsburgh Pirates", "CIN": "Cincinnati Reds", "LAD": "Los Angeles Dodgers",
    "SD": "San Diego Padres", "SF": "San Francisco Giants", "AZ": "Arizona Diamondbacks",
    "ARI": "Arizona Diamondbacks", "COL": "Colorado Rockies",
}

# --- fixed values: model inputs, in order ---------------------------------------------------------
FEATURES = [
    "home_elo", "home_win_pct", "away_win_pct",
    "sp_era_home", "sp_era_away", "sp_k9_home", "sp_k9_away",
    "woba_30g_home", "woba_30g_away",
    "bullpen_whip_10g_home", "bullpen_whip_10g_away",
    "rest_days_home", "rest_days_away",
    "sp_era_30g_home", "sp_era_30g_away", "sp_k9_30g_home", "sp_k9_30g_away",
    "home_run_diff", "away_run_diff",
    "sp_fbvelo_3g_home", "sp_fbvelo_3g_away",
    "sp_fbpct_3g_home", "sp_fbpct_3g_away",
    "sp_whiff_3g_home", "sp_whiff_3g_away",
    "sp_xwoba_vs_l_home", "sp_xwoba_vs_l_away",
    "sp_xwoba_vs_r_home", "sp_xwoba_vs_r_away",
    "team_barrel_15g_home", "team_barrel_15g_away",
    "team_hardhit_15g_home", "team_hardhit_15g_away",
    "team_exitvelo_15g_home", "team_exitvelo_15g_away",
    "opp_lefty_share_home", "opp_lefty_share_away",
    "bullpen_pitches_3d_home", "bullpen_pitches_3d_away",
    "bullpen_ip_3d_home", "bullpen_ip_3d_away",
    "lineup_woba_mean_home", "lineup_woba_mean_away",
    "lineup_woba_top3_home", "lineup_woba_top3_away",
    "lineup_woba_std_home", "lineup_woba_std_away",
]

# --- fixed values: feature names copied under the name the models expect --------------------------
FEATURE_COPIES = {
    "team_woba_30g_home": "woba_30g_home", "team_woba_30g_away": "woba_30g_away",
    "sp_era_home": "sp_era_30g_home", "sp_era_away": "sp_era_30g_away",
    "sp_k9_home": "sp_k9_30g_home", "sp_k9_away": "sp_k9_30g_away",
}

# --- fixed values: columns of the daily slate file, in order --------------------------------------
SLATE_COLUMNS = [
    "game_id", "game_date", "start_time_utc", "home_team", "away_team",
    "home_record", "away_record", "home_win_prob_model", "away_win_prob_model",
    "moneyline_home", "moneyline_away", "total_line", "run_line_home",
    "juice", "edge_home", "edge_away",
    "sp_name_home", "sp_name_away",
    "sp_era_home", "sp_k9_home", "sp_era_away", "sp_k9_away",
    "venue", "model_pick", "home_win",
]

# --- fixed values: ratings, blending, monitoring --------------------------------------------------
ELO_START = 1500.0
ELO_K = 20.0
ELO_HOME_ADVANTAGE = 65.0
ELO_REVERT = 1.0 / 3.0
RETRAIN_CADENCE = 7
MEMBER_WEIGHTS = {"boosted_a": 0.40, "boosted_b": 0.40, "logistic": 0.20}
COIN_FLIP_BAND = 0.02
UPSET_PROBABILITY = 0.35
PSI_WARN = 0.10
PSI_ALERT = 0.25
DEFAULT_JUICE = 0.04
DEFAULT_MONEYLINE = -110
