"""Defaults that decide results.  Every operator takes them as keyword arguments."""

# They must equal those of the service this package replaces.
CHUNK_LINES = 1024
OVERLAP_LINES = 200
EMBEDDING_DIM = 1024
DEFAULT_K = 5
MAX_K = 100
SEARCH_TTL_SECONDS = 3600
SUGGESTION_TTL_SECONDS = 86400
NLIST = 128
NPROBE = 10
MAX_TOKENS = 512
PAGE_SKIP = 0
PAGE_LIMIT = 20
CONFIDENCE = 0.8
LANGUAGES = {
    ".py": "Python",
    ".go": "Go",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".java": "Java",
}
IGNORED_DIRS = [
    ".git", ".venv", "venv", "node_modules", "dist", "build", "__pycache__", ".pytest_cache",
]
IGNORED_FILES = [".gitignore", ".env", ".env.local", "package-lock.json", "yarn.lock"]
ISSUE_TYPES = ["security", "lint", "performance", "style", "refactor"]
JOB_STATUSES = ["pending", "running", "completed", "failed"]
VECTOR_FIELD_BYTES = {
    "id": 256,
    "repo_id": 256,
    "file_path": 512,
    "language": 32,
    "function_name": 256,
    "class_name": 256,
}
