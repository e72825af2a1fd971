"""Schemas of the input tables."""

from __future__ import annotations

METADATA = """basename string, organoid_line string, tcell_line string, exp_nr int, well string, date string,
    dead_dye_channel int, organoid_distance_channel int, tcell_contact_threshold double, tcell_dead_dye_threshold double,
    tcell_stats_folder string, organoid_contact_threshold double, organoid_dead_dye_threshold double,
    organoid_stats_folder string, tumor_name string, imaris_object_distance boolean"""

#: Columns that locate an observation.
OBSERVATION_KEYS = ["stat_folder", "basename", "time", "track_id", "id"]
