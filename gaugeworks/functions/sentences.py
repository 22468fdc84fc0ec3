"""Sentences that reports must carry word for word."""

FOREST_REASON = "isolation forest detected feature-space outlier"
MODEL_REASON = "supervised model classified as anomalous"
HISTORY_REASON = "value is statistically extreme vs history"
NORMAL_POINT = "Normal point (fused score "
ANOMALY_AT = "⚠️ Anomaly @ "
FUSED_CONFIDENCE = ". Fused confidence: "
BIG_PICTURE = "The big picture"
ONE_THING = " thing that need attention"
MANY_THINGS = " things that need attention"
NOTHING_FOUND = "Nothing materially out of bounds in the last period."
HEADS_UP = "Heads up"
ALL_QUIET = "✅ All quiet"
