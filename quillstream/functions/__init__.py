"""Column expressions: text, dates, money, hashes, arrays. Plain built-ins; nothing here runs Python per row."""
