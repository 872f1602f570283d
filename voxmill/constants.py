"""States, legal moves, presets, thresholds."""

TASK_STATES = ("PENDING", "PREPROCESSING", "QUEUED", "DISPATCHED", "TRANSCRIBING", "SUCCEEDED", "FAILED", "CANCELED")
TRANSITIONS = {
    "PENDING": ("PREPROCESSING", "CANCELED"),
    "PREPROCESSING": ("QUEUED", "FAILED", "CANCELED"),
    "QUEUED": ("DISPATCHED", "CANCELED", "FAILED"),
    "DISPATCHED": ("TRANSCRIBING", "FAILED", "CANCELED"),
    "TRANSCRIBING": ("SUCCEEDED", "FAILED", "CANCELED"),
    "SUCCEEDED": (),
    "FAILED": ("QUEUED", "TRANSCRIBING"),
    "CANCELED": (),
}
PROGRESS_BANDS = {
    "PENDING": (0.0, 0.05),
    "PREPROCESSING": (0.05, 0.15),
    "QUEUED": (0.15, 0.20),
    "DISPATCHED": (0.20, 0.20),
    "TRANSCRIBING": (0.20, 0.95),
    "SUCCEEDED": (1.0, 1.0),
    "FAILED": (0.0, 1.0),
    "CANCELED": (0.0, 1.0),
}
TERMINAL = ("SUCCEEDED", "FAILED", "CANCELED")
ACTIVE_SLOT = ("DISPATCHED", "TRANSCRIBING")
QUEUE = ("PENDING", "PREPROCESSING", "QUEUED")
# level -> (target, longest, shortest file that is split, search step), seconds
SEGMENT_PRESETS = {"10m": (600, 720, 720, 60), "20m": (1200, 1440, 1440, 120), "30m": (1800, 2160, 2160, 180)}
MEDIA_EXTENSIONS = (".wav", ".mp3", ".mp4", ".flac", ".ogg", ".webm", ".m4a", ".aac", ".wma", ".mkv", ".avi", ".mov", ".pcm")
AUDIO_EXTENSIONS = (".wav", ".mp3", ".flac", ".ogg", ".m4a", ".aac", ".wma", ".pcm")
VIDEO_EXTENSIONS = (".mp4", ".webm", ".mkv", ".avi", ".mov")
# bytes a second by extension, for a rough duration
BYTE_RATES = {
    ".wav": 32000, ".pcm": 32000, ".flac": 24000,
    ".mp3": 16000, ".m4a": 16000, ".aac": 16000, ".ogg": 16000, ".wma": 16000,
    ".mp4": 20000, ".mkv": 20000, ".webm": 20000, ".avi": 20000, ".mov": 20000, ".wmv": 20000,
}
UPLOAD_CAP_BYTES = 2048 * 1024 * 1024
EXPORT_CAP_BYTES = 500 * 1024 * 1024
MAX_RETRIES = 3
OUTBOX_RETRIES = 5
TASK_TIMEOUT_S = 3600
STALE_CLAIM_S = 300
RECOVERY_MINUTES = 10
HEARTBEAT_TIMEOUT_S = 90
SEGMENTS_AT_ONCE = 3
EMPTY_RESULT_TASK_S = 30
EMPTY_RESULT_SEGMENT_S = 10
PROGRESS_TEXT = {
    "PENDING": "等待处理",
    "PREPROCESSING": "预处理中（元信息提取/格式转换）",
    "QUEUED": "排队中",
    "DISPATCHED": "已分配服务器，准备开始转写",
    "TRANSCRIBING": "转写中",
    "SUCCEEDED": "转写完成",
    "FAILED": "转写失败",
    "CANCELED": "已取消",
}
SYSTEM_FILES = ("Thumbs.db", ".DS_Store")
# intake keywords
STRONG_WORDS = ("转写", "语音转文本", "语音识别", "生成字幕", "批量转写", "transcribe", "speech to text", "generate subtitle", "batch transcribe")
MEDIUM_WORDS = ("识别", "字幕", "转文字", "批量任务", "批量处理", "subtitle", "asr", "recognize speech")
SENSITIVE_WORDS = ("保密", "加密", "机密", "隐私", "敏感", "不要落盘", "私密会议", "法律录音", "医疗", "合同", "病历", "内部会议", "encrypted", "confidential", "private")
NOT_MEDIA = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".pdf", ".docx", ".xlsx", ".pptx", ".txt", ".csv")
