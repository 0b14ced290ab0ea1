"""Column expressions; nothing here touches a session or a DataFrame."""
