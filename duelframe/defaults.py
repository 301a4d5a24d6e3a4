"""Settings of the noise study that results depend on."""

# labels
NOISE_KIND = "flip_labels"
NOISE_LEVELS = (0.0, 0.01, 0.05, 0.1, 0.2)
NOISE_SEED = 42

# training tables
VALIDATION_ROWS = 2000
MAX_TOKENS = 128
LM_LENGTH = 550
IGNORED_LABEL = -100

# sampled sizes, the upper bound excluded
PROMPT_LENGTHS = (50, 128)
RESPONSE_LENGTHS = (10, 25)
SAMPLING_SEED = 42
SAMPLED_PROMPTS = 2000
CANDIDATES = 4

# vocabulary
END_OF_TEXT = "<|endoftext|>"
PADDING = "[PAD]"
