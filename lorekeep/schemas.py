"""Row types."""

MEMORY = "id string, content string, category string, scope_type string, scope_key string, status string, confidence double, source_harness string, source_session string, evidence string, created_at string, last_retrieved string, times_retrieved long, times_used long, superseded_by string, conflict_with string, episode_id string"
EPISODE = "id string, session_id string, source_harness string, scope_type string, scope_key string, summary string, excerpt string, transcript_path string, transcript_format string, turn_start long, turn_end long, created_at string"
#: The change log; memory and episode hold what an add event brings.
EVENT = f"seq long, ts string, action string, entity_id string, detail string, memory struct<{MEMORY.replace(' ', ':').replace(',:', ',')}>, episode struct<{EPISODE.replace(' ', ':').replace(',:', ',')}>, embedding array<float>"
TURNS = "path string, turn_idx long, role string, text string"
BOOKMARKS = "seq long, path string, hash string, turns long"
VERSION = 2
