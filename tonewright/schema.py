"""Schemas at the boundaries."""

from __future__ import annotations

DETECTION_FIELDS = (
    "species string, species_id int, confidence double, time_start double, time_end double, freq_low_hz int, freq_high_hz int, "
    "clip_start double, clip_end double, filename string, file_path string"
)
SONG_FIELDS = (
    "species string, species_id int, time_start double, time_end double, avg_confidence double, max_confidence double, "
    "detections_merged bigint, freq_low_hz int, freq_high_hz int, filename string"
)
MODEL_CONFIG = "struct<model:string,confidence_threshold:double,nms_iou_threshold:double,song_gap_threshold:double,species_mapping:string>"


def _struct(fields: str) -> str:
    return ",".join(f"{a}:{b}" for a, b in (f.split() for f in fields.split(", ")))


#: One detections document, of one file or of several.
DOCUMENT = (
    f"audio_file string, audio_files array<string>, file_count int, model_config {MODEL_CONFIG}, detection_count bigint, "
    "filtering_config struct<confidence_threshold:double,song_gap_threshold:double>, original_detection_count bigint, "
    f"detections array<struct<{_struct(DETECTION_FIELDS)},avg_confidence:double,max_confidence:double,detections_merged:bigint>>"
)

#: Column names of label and detection CSV files, in their order.
CSV_COLUMNS = {
    "Filename": "filename string",
    "Start Time (s)": "time_start double",
    "End Time (s)": "time_end double",
    "Low Freq (Hz)": "freq_low_hz double",
    "High Freq (Hz)": "freq_high_hz double",
    "Species eBird Code": "species string",
}
BOX_FIELDS = "filename string, clip_start double, clip_end double, cls int, conf float, x1 float, y1 float, x2 float, y2 float"
AUDIO_EXTENSIONS = ("wav", "flac", "ogg", "mp3")
