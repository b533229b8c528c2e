"""Rule tables, word lists, thresholds and texts.

Everything in this file is data that must have exactly these values for results to be right.
Operators read it; none of it is logic. Each table can be replaced by the caller.
"""

# ---------------------------------------------------------------------------
# Pairwise version conflicts (fixed values):
# (package1, package2, version pattern 1, version pattern 2, severity, resolution)
CONFLICT_RULES = [
    ("torch", "torchvision", r"^2\.\d+\.\d+", r"^0\.1[0-4]\.\d+", "critical",
     "Use torch 2.0+ with torchvision 0.15+ or torch 1.13.x with torchvision 0.14.x"),
    ("torch", "torchvision", r"^1\.13\.\d+", r"^0\.1[5-9]\.\d+", "critical",
     "Use torch 2.0+ with torchvision 0.15+ or torch 1.13.x with torchvision 0.14.x"),
    ("torch", "torchaudio", r"^2\.\d+\.\d+", r"^0\.\d+\.\d+", "critical",
     "Use matching major versions: torch 2.x with torchaudio 2.x"),
    ("transformers", "torch", r"^4\.2[0-9]\.\d+", r"^1\.[0-8]\.\d+", "critical",
     "Update torch to 1.10+ for transformers 4.30+"),
    ("transformers", "torch", r"^4\.[3-9][0-9]\.\d+", r"^1\.9\.\d+", "warning",
     "Update torch to 1.10+ for transformers 4.30+"),
    ("xformers", "torch", r"^0\.0\.2[0-9]", r"^2\.[0-3]\.\d+", "warning",
     "Check xformers compatibility matrix for your torch version"),
    ("tensorflow", "torch", r".*", r".*", "warning",
     "Consider using separate environments for TensorFlow and PyTorch"),
    ("ultralytics", "torch", r"^8\.3\.40", r"^2\.4\.\d+", "critical",
     "Use ultralytics 8.3.41+ with torch 2.4.0+"),
    ("accelerate", "transformers", r"^0\.2[0-9]\.\d+", r"^4\.[0-2][0-7]\.\d+", "warning",
     "Update transformers to 4.28+ for accelerate 0.20+"),
    ("diffusers", "transformers", r"^0\.2[0-9]\.\d+", r"^4\.2[0-4]\.\d+", "warning",
     "Update transformers to 4.25+ for diffusers 0.20+"),
    ("datasets", "pandas", r"^2\.1[4-9]\.\d+", r"^2\.\d+\.\d+", "warning",
     "Use pandas 1.5.x with datasets 2.14+ or wait for updates"),
    ("scipy", "numpy", r"^1\.1[1-9]\.\d+", r"^1\.[0-2]0\.\d+", "critical",
     "Update numpy to 1.21+ for scipy 1.11+"),
]

# Known-bad versions (fixed values): (package, version, severity, description, resolution)
PROBLEM_VERSIONS = [
    ("numpy", "1.24.0", "warning", "numpy 1.24.0 has breaking API changes",
     "Consider using numpy<1.24 or >=1.24.1"),
    ("pandas", "2.0.0", "warning", "pandas 2.0.0 has significant breaking changes",
     "Review migration guide if upgrading from 1.x"),
    ("scikit-learn", "1.3.0", "info", "scikit-learn 1.3.0 deprecates several features",
     "Check deprecation warnings in your code"),
]

# Accelerator runtimes a framework version supports (fixed values), in lookup order
CUDA_SUPPORT = {
    "torch": [
        ("2.0.0", ["11.7", "11.8"]), ("2.0.1", ["11.7", "11.8"]),
        ("2.1.0", ["11.8", "12.1"]), ("2.1.1", ["11.8", "12.1"]), ("2.1.2", ["11.8", "12.1"]),
        ("2.2.0", ["11.8", "12.1"]), ("2.2.1", ["11.8", "12.1"]), ("2.2.2", ["11.8", "12.1"]),
        ("2.3.0", ["11.8", "12.1", "12.4"]), ("2.3.1", ["11.8", "12.1", "12.4"]),
        ("2.4.0", ["11.8", "12.1", "12.4"]), ("2.4.1", ["11.8", "12.1", "12.4"]),
        ("2.5.0", ["11.8", "12.1", "12.4", "12.6"]),
    ],
    "tensorflow": [
        ("2.13.0", ["11.8"]), ("2.14.0", ["11.8"]), ("2.15.0", ["11.8", "12.2"]),
        ("2.16.0", ["12.2", "12.3"]), ("2.17.0", ["12.3", "12.5"]),
    ],
    "jax": [
        ("0.4.20", ["11.8", "12.2"]), ("0.4.23", ["11.8", "12.2", "12.3"]),
        ("0.4.25", ["12.2", "12.3"]),
    ],
}

# Runtime ranges per framework version (fixed values), in lookup order:
# (version, lowest runtime, highest runtime, recommended runtimes)
CUDA_RANGES = {
    "torch": [
        ("2.5.0", "11.8", "12.6", ["12.1", "12.4"]),
        ("2.4.1", "11.8", "12.4", ["12.1", "12.4"]), ("2.4.0", "11.8", "12.4", ["12.1", "12.4"]),
        ("2.3.1", "11.8", "12.4", ["11.8", "12.1"]), ("2.3.0", "11.8", "12.4", ["11.8", "12.1"]),
        ("2.2.2", "11.8", "12.1", ["11.8", "12.1"]), ("2.2.1", "11.8", "12.1", ["11.8", "12.1"]),
        ("2.2.0", "11.8", "12.1", ["11.8", "12.1"]), ("2.1.2", "11.8", "12.1", ["11.8", "12.1"]),
        ("2.1.1", "11.8", "12.1", ["11.8", "12.1"]), ("2.1.0", "11.8", "12.1", ["11.8", "12.1"]),
        ("2.0.1", "11.7", "11.8", ["11.7", "11.8"]), ("2.0.0", "11.7", "11.8", ["11.7", "11.8"]),
        ("1.13.1", "11.6", "11.7", ["11.6", "11.7"]), ("1.13.0", "11.6", "11.7", ["11.6", "11.7"]),
        ("1.12.1", "10.2", "11.6", ["11.3", "11.6"]), ("1.12.0", "10.2", "11.6", ["11.3", "11.6"]),
    ],
    "tensorflow": [
        ("2.17.0", "12.3", "12.5", ["12.3"]), ("2.16.2", "12.2", "12.3", ["12.3"]),
        ("2.16.1", "12.2", "12.3", ["12.3"]), ("2.16.0", "12.2", "12.3", ["12.3"]),
        ("2.15.1", "11.8", "12.2", ["12.2"]), ("2.15.0", "11.8", "12.2", ["12.2"]),
        ("2.14.1", "11.8", "11.8", ["11.8"]), ("2.14.0", "11.8", "11.8", ["11.8"]),
        ("2.13.1", "11.8", "11.8", ["11.8"]), ("2.13.0", "11.8", "11.8", ["11.8"]),
        ("2.12.0", "11.8", "11.8", ["11.8"]), ("2.11.0", "11.2", "11.2", ["11.2"]),
    ],
    "jax": [
        ("0.4.25", "12.2", "12.3", ["12.3"]), ("0.4.24", "12.2", "12.3", ["12.3"]),
        ("0.4.23", "11.8", "12.3", ["12.2"]), ("0.4.20", "11.8", "12.2", ["11.8", "12.2"]),
        ("0.4.14", "11.8", "12.0", ["11.8"]), ("0.4.13", "11.8", "11.8", ["11.8"]),
    ],
    "cupy": [
        ("13.0.0", "11.2", "12.3", ["12.x"]), ("12.3.0", "11.2", "12.2", ["11.8", "12.x"]),
        ("12.0.0", "11.2", "12.0", ["11.8"]), ("11.6.0", "10.2", "11.8", ["11.2", "11.8"]),
    ],
    "mxnet": [
        ("1.9.1", "10.2", "11.2", ["11.2"]), ("1.9.0", "10.2", "11.2", ["11.2"]),
        ("1.8.0", "10.1", "11.0", ["10.2"]),
    ],
}

# Lowest compute capability per runtime (fixed values)
CUDA_COMPUTE_CAPABILITY = {
    "10.0": "3.5", "10.1": "3.5", "10.2": "3.5",
    "11.0": "3.5", "11.1": "3.5", "11.2": "3.5", "11.3": "3.5", "11.4": "3.5",
    "11.5": "3.5", "11.6": "3.5", "11.7": "3.5", "11.8": "3.5",
    "12.0": "5.0", "12.1": "5.0", "12.2": "5.0", "12.3": "5.0", "12.4": "5.0",
    "12.5": "5.0", "12.6": "5.0",
}

# Runtime families that clash (fixed values): (family 1, family 2, message)
RUNTIME_CONFLICTS = [
    ("11", "12", "CUDA 11.x and 12.x runtime libraries are incompatible"),
    ("10", "11", "CUDA 10.x and 11.x have ABI incompatibilities"),
]

# Stored compatibility matrices (fixed values): (package, version, values)
STORED_CUDA_MATRIX = [
    ("pytorch", "1.13.0", ["11.6", "11.7"]), ("pytorch", "1.12.0", ["11.3", "11.6"]),
    ("pytorch", "2.0.0", ["11.7", "11.8"]), ("pytorch", "2.1.0", ["11.8", "12.1"]),
    ("tensorflow", "2.10.0", ["11.2"]), ("tensorflow", "2.11.0", ["11.2", "11.8"]),
    ("tensorflow", "2.12.0", ["11.8"]), ("tensorflow", "2.13.0", ["11.8"]),
]
STORED_PYTHON_MATRIX = [
    ("pytorch", "1.13.0", ["3.7", "3.8", "3.9", "3.10"]),
    ("pytorch", "2.0.0", ["3.8", "3.9", "3.10", "3.11"]),
    ("pytorch", "2.1.0", ["3.8", "3.9", "3.10", "3.11"]),
    ("tensorflow", "2.10.0", ["3.7", "3.8", "3.9", "3.10"]),
    ("tensorflow", "2.11.0", ["3.7", "3.8", "3.9", "3.10", "3.11"]),
    ("tensorflow", "2.12.0", ["3.8", "3.9", "3.10", "3.11"]),
]

# Frameworks whose runtime range is checked against a system (fixed values)
RANGE_CHECKED_FRAMEWORKS = ["torch", "tensorflow", "jax", "mxnet"]

# ---------------------------------------------------------------------------
# Package name lists (fixed values)
GPU_REQUIREMENT_PACKAGES = ["torch", "tensorflow", "tensorflow-gpu", "cupy", "numba", "jax",
                            "jaxlib", "paddle", "mxnet", "mindspore"]
GPU_IMPORT_PACKAGES = ["torch", "tensorflow", "tf", "cupy", "numba", "jax",
                       "jaxlib", "paddle", "mxnet", "mindspore"]
GPU_FEATURE_PACKAGES = ["torch", "tensorflow", "jax", "cupy", "numba", "cudf",
                        "rapids", "xgboost", "lightgbm", "catboost", "optuna"]
ML_PACKAGES = ["torch", "tensorflow", "keras", "jax", "mxnet", "paddlepaddle",
               "transformers", "huggingface_hub", "datasets", "accelerate",
               "diffusers", "xformers", "bitsandbytes", "optimum", "peft",
               "trl", "sentencepiece", "tokenizers", "protobuf", "onnx",
               "onnxruntime", "triton", "flash_attn", "deepspeed", "fairscale"]
ML_FRAMEWORKS = ["torch", "tensorflow", "jax", "mxnet"]
MODEL_ML_PACKAGES = ["torch", "tensorflow", "jax", "keras"]
GPU_MEMORY_PACKAGES = ["torch", "tensorflow"]
RESEARCH_KEYWORDS = ["research", "paper", "experiment", "thesis", "study"]
CONDA_CAPABLE_WORDS = ["torch", "tensorflow", "numpy", "scipy", "pandas", "sklearn"]
CONDA_EXACT_PACKAGES = ["numpy", "scipy", "pandas", "matplotlib", "scikit-learn", "jupyter"]
MICROMAMBA_PACKAGE_WORDS = ["numpy", "scipy", "pandas", "matplotlib", "scikit-learn", "jupyter",
                            "pytorch", "tensorflow", "tensorflow-gpu", "cudatoolkit", "cudnn",
                            "pillow", "opencv", "imageio", "tqdm", "requests", "pyyaml"]

# Import name -> package name, and imports that are never packages (fixed values)
IMPORT_MAP = {"cv2": "opencv-python", "PIL": "pillow", "sklearn": "scikit-learn",
              "tf": "tensorflow", "np": "numpy", "pd": "pandas",
              "plt": "matplotlib", "sns": "seaborn"}
IMPORT_SKIP = ["builtins", "sys", "os"]

# ---------------------------------------------------------------------------
# File candidates (fixed values), in lookup order
MANIFEST_FILES = ["requirements.txt", "setup.py", "pyproject.toml", "environment.yml",
                  "Pipfile", "poetry.lock"]
DOCKER_FILES = ["Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".dockerignore"]
CI_FILES = [".github/workflows", ".gitlab-ci.yml", ".travis.yml", "azure-pipelines.yml",
            ".circleci/config.yml"]
README_FILES = ["README.md", "README.rst", "README.txt", "readme.md"]
README_LOOKUP_FILES = ["README.md", "README.rst", "README.txt", "README"]
WORKFLOW_FILES = [".github/workflows/test.yml", ".github/workflows/ci.yml",
                  ".github/workflows/main.yml", ".github/workflows/python-app.yml"]
COMPOSE_FILES = ["docker-compose.yml", "docker-compose.yaml"]
SOURCE_FILE_LIMIT = 10
SOURCE_FILE_MAX_BYTES = 50000

# Readme patterns (fixed values), in match order: (pattern, group that holds the version)
README_PYTHON_PATTERNS = [
    (r"python\s*([><=!~]+)\s*([0-9.]+)", 2),
    (r"requires\s+python\s*([><=!~]+)\s*([0-9.]+)", 2),
    (r"python\s+([0-9.]+)\s*or\s+higher", 1),
    (r"python\s+([0-9.]+)\+", 1),
]
README_CUDA_WORDS = ["cuda", "gpu", "nvidia", "cudnn", "tensorrt"]
README_GPU_PATTERNS = [r"requires?\s+gpu", r"gpu\s+required", r"cuda\s+required", r"nvidia\s+gpu"]
README_INSTALL_PATTERNS = [r"pip install[^\n]+", r"conda install[^\n]+",
                           r"apt-get install[^\n]+", r"brew install[^\n]+"]
README_REQUIREMENT_PATTERNS = [r"requirements?:([^\n]+)", r"dependencies:([^\n]+)",
                               r"prerequisites:([^\n]+)"]
CI_TEST_PATTERNS = [r"run:\s*([^\n]*test[^\n]*)", r"run:\s*([^\n]*pytest[^\n]*)",
                    r"run:\s*([^\n]*unittest[^\n]*)", r"run:\s*([^\n]*tox[^\n]*)"]

# ---------------------------------------------------------------------------
# Installer log patterns (fixed values), in match order: (kind, pattern)
PIP_PATTERNS = [
    ("has_requirement", r"ERROR: .* has requirement (.+)==([0-9.]+), but you'll have (.+) ([0-9.]+) which is incompatible"),
    ("cannot_install", r"ERROR: Cannot install .* because these package versions have conflicting dependencies"),
    ("resolver_notice", r"ERROR: pip's dependency resolver does not currently take into account all the packages"),
    ("no_distribution", r"ERROR: No matching distribution found for (.+)"),
    ("unsatisfied", r"ERROR: Could not find a version that satisfies the requirement (.+)"),
    ("wheel_build", r"ERROR: Failed building wheel for (.+)"),
    ("compiler", r"error: Microsoft Visual C\+\+ .+ is required"),
    ("platform", r"ERROR: .+ is not a supported wheel on this platform"),
]
PIP_RESOLUTION_TIPS = {
    "version_conflict": [
        "Try installing packages in a specific order",
        "Use pip install --force-reinstall to override conflicts",
        "Create a fresh virtual environment",
        "Manually specify compatible versions"],
    "missing_dependency": [
        "Check if the package name is correct",
        "Try upgrading pip: pip install --upgrade pip",
        "Check if you need to use a different index: --index-url or --extra-index-url",
        "The package might not be available for your Python version"],
    "build_error": [
        "Install build dependencies (e.g., gcc, python-dev)",
        "Try installing a pre-built wheel instead",
        "Check if you have the required system libraries",
        "Consider using conda instead for complex packages"],
    "platform_mismatch": [
        "Check your platform and Python version",
        "Look for platform-specific wheels",
        "Build from source if wheels aren't available",
        "Use a Docker container with the correct platform"],
}
PIP_ML_TIP = "Consider using conda for ML packages with complex dependencies"
PIP_PIN_TIP = "Create a requirements.txt with exact versions that work together"

# Thinking-block patterns in model responses (fixed values), in match order
THINKING_PATTERNS = [
    r"(?is)</think>\s*(.*?)(?=<think>|$)",
    r"(?is)</thinking>\s*(.*?)(?=<thinking>|$)",
    r"(?is)</?think(?:ing)?>.*?</think(?:ing)?>\s*(.*)",
]

# ---------------------------------------------------------------------------
# Strategies (fixed values): (name, priority, setup seconds, size MB, can use a GPU)
STRATEGIES = [
    ("docker", 10, 300, 2048, True),
    ("micromamba", 9, 120, 819, True),
    ("conda", 8, 180, 1024, True),
    ("venv", 5, 60, 256, False),
]
SCORED_STRATEGIES = ["docker", "conda", "venv"]
DEFAULT_PYTHON_VERSION = "3.10"
DEFAULT_CUDA_VERSION = "11.8"

# Presets (fixed values):
# (name, strategy, gpu mode, validation, cache, response analysis, learning)
PRESETS = [
    ("ml-research", "conda", "flexible", False, True, True, True),
    ("production", "docker", "strict", True, True, False, None),
    ("development", "venv", "cpu_fallback", False, True, True, True),
    ("ci-cd", "docker", "flexible", True, False, False, None),
    ("quick", "auto", "cpu_fallback", False, True, False, False),
    ("learning", "auto", "flexible", True, True, True, True),
]

# ---------------------------------------------------------------------------
# Error categories (fixed values), in match order: (category, words)
ERROR_CATEGORIES = [
    ("gpu_error", ["cuda", "gpu"]),
    ("permission_error", ["permission", "denied"]),
    ("network_error", ["network", "connection"]),
    ("memory_error", ["memory", "oom"]),
    ("dependency_error", ["dependency", "import"]),
    ("build_error", ["build", "compile"]),
]
ERROR_FIXES = {
    "gpu_error": "Check CUDA version compatibility and GPU availability",
    "permission_error": "Verify file permissions and user access",
    "network_error": "Check internet connection and proxy settings",
    "memory_error": "Increase available memory or reduce resource usage",
    "dependency_error": "Update or reinstall conflicting dependencies",
    "build_error": "Check build tools and compiler versions",
    "unknown_error": "Review error logs for specific issues",
}
ERROR_FIX_DEFAULT = "Review error details for specific solution"
ERROR_TIPS = {
    "gpu_error": ["Check CUDA version compatibility", "Verify GPU availability and drivers",
                  "Consider CPU-only alternatives"],
    "dependency_error": ["Update conflicting dependencies", "Use virtual environment isolation",
                         "Check version constraints"],
    "permission_error": ["Check file permissions", "Run with appropriate user privileges",
                         "Verify directory access rights"],
    "memory_error": ["Increase available memory", "Reduce batch size or model complexity",
                     "Use memory-efficient alternatives"],
    "network_error": ["Check internet connection", "Configure proxy settings if needed",
                      "Retry with different network"],
}
ERROR_TIP_DEFAULT = "Review error logs for specific issues"
CONFLICT_ACTIONS = {
    "ml_framework_conflict": "Use separate environments for different ML frameworks",
    "cuda_version_conflict": "Standardize CUDA version across all dependencies",
}
CONFLICT_ACTION_DEFAULT = "Review dependency versions for compatibility"

# Case similarity weights (fixed values)
CASE_WEIGHTS = {"ml_dependencies": 0.3, "gpu_dependencies": 0.2, "total_dependencies": 0.1,
                "is_ml_repo": 0.2, "python_version_required": 0.1, "cuda_version_required": 0.1}

# Data-quality ranges and defaults (fixed values)
OUTLIER_RANGES = {"star_count": (0, 1000000), "total_dependencies": (0, 1000),
                  "cpu_cores": (1, 128), "memory_gb": (1, 1000), "gpu_memory_total": (0, 1000)}
FEATURE_DEFAULTS = {"star_count": 0, "fork_count": 0, "total_dependencies": 0,
                    "gpu_dependencies": 0, "ml_dependencies": 0, "cpu_cores": 1, "memory_gb": 4,
                    "gpu_count": 0, "gpu_memory_total": 0, "success": 0, "duration": 0,
                    "confidence_score": 0.5, "complexity_score": 0.0}

# Stage targets in seconds (fixed values)
SLA_TARGETS = {"profile_agent": 2.0, "analysis_agent": 10.0, "resolution_agent": 5.0}
HEALTH_RANK = {"healthy": 0, "degraded": 1, "unhealthy": 2}

# Learning advice (fixed values): (metric, comparison, threshold, text)
LEARNING_ADVICE = [
    ("success_rate", "<", 0.7, "Success rate is below 70%. Consider retraining models with more data."),
    ("model_accuracy", "<", 0.8, "Model accuracy is below 80%. Consider feature engineering or more training data."),
    ("pattern_count", "<", 10, "Few patterns discovered. Run pattern discovery with more data."),
    ("learning_velocity", "<", 0.05, "Learning velocity is low. Consider increasing retraining frequency."),
    ("storage_size_mb", ">", 1000, "Storage size is large. Consider cleaning up old data."),
    ("seconds_since_update", ">", 604800, "Models haven't been updated recently. Consider retraining."),
]
RETRAIN_INTERVAL_SECONDS = 86400
RETRAIN_MIN_SAMPLES = 10
FEEDBACK_MIN = 5
CACHE_TTL_SECONDS = 3600

# What speaks for or against a strategy (fixed values): where a repository's number exceeds the bound, the text of the
# strategy, or the one under "other" where there is one; "on_gpu" texts ask for a GPU of the system
REASONS = [
    {"feature": "gpu_dependencies", "above": 0, "on_gpu": True,
     "docker": "Docker supports GPU requirements", "conda": "Conda can handle GPU dependencies",
     "other": "GPU dependencies may be challenging"},
    {"feature": "ml_dependencies", "above": 2, "on_gpu": False,
     "docker": "Docker provides isolated ML environment", "conda": "Conda handles complex ML dependencies well"},
    {"feature": "total_dependencies", "above": 20, "on_gpu": False,
     "docker": "Docker containerizes complex dependencies", "conda": "Conda manages many dependencies effectively"},
]
# Level of a probability that no reason explains: (above, word)
REASON_LEVELS = [(0.7, "high"), (0.4, "moderate"), (None, "low")]

# Strategies that a resolution may name (fixed values)
CONTRACT_STRATEGIES = ["docker", "conda", "venv", "devcontainer"]
