"""Cards that explain rules, and checks of what they say."""
