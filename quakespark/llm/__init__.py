"""Operations of a training-data pipeline: near-duplicates, personal data, tokens, language models, mixing, chat."""
